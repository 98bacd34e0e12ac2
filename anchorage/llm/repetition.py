"""Operator 10, quality rules: repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over Arrow batches,
measure what share of a text's word characters lies inside n-grams that
occur twice or more in it, and what share lies in repeated lines.  Every
text is judged alone: no shuffle, no state, memory bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.words import IS_LEAD, Words, mix, seeded, sliced, span_hash

#: Most percent of word characters inside repeated n-grams, by n-gram length.
NGRAM_PERCENT = {5: 20, 7: 15, 10: 10}
#: Most percent of word characters inside lines equal to an earlier line.
LINE_PERCENT = 30
MIN_WORDS = 10
REPEAT_WINDOW, REPEAT_PERCENT = 5, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SALT = seeded(10, 2)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


def _own(words: Words, doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes made different for different texts."""
    return mix(hashes ^ mix(doc.astype(np.uint64) + _SALT[0]))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier key."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which words lie inside the windows of ``n`` words that begin at ``at``."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(words: Words, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of a slice of texts, one value per text."""
    n_docs = len(words.bounds) - 1
    lead = IS_LEAD[words.data] & words.is_word
    out = {
        "n_words": np.diff(words.first),
        "word_chars": words.per_doc(lead),
        "n_symbols": words.per_doc(_SYMBOL[words.data]),
    }
    chars_before = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(lead, out=chars_before[1:])
    word_chars = chars_before[words.end] - chars_before[words.start]

    newline = np.flatnonzero(words.data == 0x0A)
    begin = np.sort(np.concatenate([words.bounds[:-1], newline + 1]))
    end = np.sort(np.concatenate([newline, words.bounds[1:]]))
    line_chars = chars_before[end] - chars_before[begin]
    full = np.flatnonzero(line_chars)
    begin, end, line_chars = begin[full], end[full], line_chars[full]
    doc = np.searchsorted(words.bounds, begin, "right") - 1
    again = _later(_own(words, doc, span_hash(words.prefix, begin, end)))
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n_docs)
    out["dup_line_chars"] = np.bincount(doc[again], line_chars[again], n_docs).astype(np.int64)

    for n in lengths:
        at, hashes = words.windows(n)
        inside = covered(len(words), at[repeated(_own(words, words.doc[at], hashes))], n)
        if n == REPEAT_WINDOW:
            out["n_repeat_words"] = np.bincount(words.doc[inside], minlength=n_docs)
        out[f"dup_{n}"] = np.bincount(words.doc[inside], word_chars[inside], n_docs).astype(np.int64)
    return out


def verdicts(m: dict[str, np.ndarray], limits: dict[int, int], line_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of each text from its counts."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    kept = ~failed & (100 * m["dup_line_chars"] <= line_percent * m["word_chars"])
    for n, percent in limits.items():
        kept &= 100 * m[f"dup_{n}"] <= percent * m["word_chars"]
    return failed, kept


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       ngram_percent: dict[int, int] | None = None, line_percent: int = LINE_PERCENT) -> DataFrame:
    """One row per document: its counts, ``base_failed`` and the verdict ``kept``.

    A null or empty text has no words and fails (fewer than ``MIN_WORDS``).
    Repeated rows give repeated results; a null id is kept as null; columns other
    than the two are not read.  A document is kept unless it is ``base_failed``
    or the share of its word characters inside repeated n-grams of a length in
    ``ngram_percent``, or in repeated lines, is above that many percent.
    ``dup_n`` is the number of word characters inside repeated n-grams.
    """
    limits = dict(sorted((NGRAM_PERCENT if ngram_percent is None else ngram_percent).items()))
    lengths = tuple(sorted({*limits, REPEAT_WINDOW}))
    counts = [*COUNTS, *(f"dup_{n}" for n in lengths)]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo, hi, words in sliced(batch.column(1)):
                m = measure(words, lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(m[k], pa.int64()) for k in counts),
                     *map(pa.array, verdicts(m, limits, line_percent))],
                    names=["doc_id", *counts, "base_failed", "kept"])

    schema = ", ".join(["doc_id long", *(f"{k} long" for k in counts), "base_failed boolean", "kept boolean"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
                       ).mapInArrow(batches, schema)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return repetition_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are.

    The verdict is taken beside the other columns, so nothing is joined.
    """
    at = docs.columns.index(text_col)
    lengths = tuple(sorted({*NGRAM_PERCENT, REPEAT_WINDOW}))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            kept = [verdicts(measure(words, lengths), NGRAM_PERCENT, LINE_PERCENT)[1]
                    for _, _, words in sliced(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(batches, docs.schema)


def _duplicates_sql(n: int) -> str:
    return f"""g{n} AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n}))),
c{n} AS (
  SELECT doc_id, count(*) AS n, sum(length(ws[j])) AS chars
  FROM (SELECT DISTINCT doc_id, i + unnest(range({n})) AS j FROM g{n} WHERE c >= 2) JOIN w USING (doc_id)
  GROUP BY doc_id)"""


OP10_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
{_duplicates_sql(5)},
{_duplicates_sql(7)},
{_duplicates_sql(10)},
l AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) > 1 AS again
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (
  SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars
  FROM l WHERE again GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c5.n, 0)::BIGINT AS n_repeat_words,
         coalesce(d.chars, 0)::BIGINT AS dup_line_chars, coalesce(c5.chars, 0)::BIGINT AS dup_5,
         coalesce(c7.chars, 0)::BIGINT AS dup_7, coalesce(c10.chars, 0)::BIGINT AS dup_10
  FROM w LEFT JOIN d USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c7 USING (doc_id)
  LEFT JOIN c10 USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_PERCENT} * word_chars
          AND 100 * dup_5 <= {NGRAM_PERCENT[5]} * word_chars AND 100 * dup_7 <= {NGRAM_PERCENT[7]} * word_chars
          AND 100 * dup_10 <= {NGRAM_PERCENT[10]} * word_chars AS kept
FROM b"""
