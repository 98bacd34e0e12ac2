"""Operator 7, substring dedup: level-wise doubling.

A window of ``2 * n`` words can only repeat in another document if its windows of ``n``
words do.  So windows of the shorter length are matched first, and only what
repeats is extended to twice the length, up to the length asked for.  The shorter
level needs only some windows: of each run that one long window spans, those of least hash
(equal long windows choose equal short ones, so none is missed).

Each level sends (hash, document) pairs: the least document of each hash is found by
partial aggregation and joined back, so a passage that a third of all documents
share is one sum per task and a join that Spark can split.
Documents that equal an earlier one as a whole are told by one hash and take part in no level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.repetition import covered
from anchorage.llm.words import Words, mix, prefix_hash, seeded, sliced, span_hash
from anchorage.session import materialize

WINDOW = 50
_WHOLE, _DOC = seeded(7, 2)


def _sliding(values: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``n`` consecutive values, by doubling spans."""
    out, width = values, 1
    while 2 * width <= n:
        out, width = pick(out[:-width], out[width:]), 2 * width
    rest = n - width
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def chosen(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places that hold the least hash of some ``span`` consecutive places."""
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    least = _sliding(hashes, span, np.minimum)
    edge = np.zeros(span - 1, hashes.dtype)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), span, np.maximum) == hashes)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _distinct(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, in order."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def _lists(groups: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list for each of ``n`` groups, of the values of sorted ``groups``."""
    offsets = np.searchsorted(groups, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(values))


def _whole_hash(words: Words) -> np.ndarray:
    """A hash of each text's word sequence."""
    return mix(span_hash(prefix_hash(words.hash), words.first[:-1], words.first[1:]) ^ _WHOLE)


def _in_own(words: Words, doc: np.ndarray, hashes: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which hashes are in the list of their own document."""
    n = len(words.bounds) - 1
    offsets = np.asarray(lists.offsets)
    held = np.asarray(lists.flatten()).view(np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    own = lambda d, h: mix(h ^ mix(d.astype(np.uint64) + _DOC))
    return np.isin(own(doc, hashes), own(owner, held))


def _short(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First words and hashes of the chosen windows of half the length, and that length."""
    half = window // 2
    at, hashes = words.windows(half)
    k = chosen(hashes, window - half + 1)
    return at[k], hashes[k], half


def _repeated(rows: DataFrame) -> DataFrame:
    """``rows(hash, doc_id)`` whose hash occurs in two documents or more, with the least ``first``."""
    least = (rows.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
             .where("first < last").select("hash", "first"))
    return rows.join(least, "hash")


def _per_document(rows: DataFrame) -> DataFrame:
    """(doc_id, hashes): at most as many as a document has windows."""
    return rows.groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))


def short_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, whole, hashes): hash of the whole word sequence and of the chosen windows of half the length."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo, hi, words in sliced(batch.column(1)):
                at, hashes, _ = _short(words, window)
                long = np.diff(words.first) >= window
                at, hashes = at[long[words.doc[at]]], hashes[long[words.doc[at]]]
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), _signed(_whole_hash(words)),
                     _lists(*_distinct(words.doc[at], hashes), hi - lo)], names=["doc_id", "whole", "hashes"])
                yield out.filter(pa.array(long))

    return docs.mapInArrow(batches, "doc_id long, whole long, hashes array<long>")


def extended(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, hash) of the full-length windows around the surviving short ones of ``docs(doc_id, text, hashes)``."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo, hi, words in sliced(batch.column(1)):
                at, hashes, half = _short(words, window)
                at = at[_in_own(words, words.doc[at], hashes, batch.column(2).slice(lo, hi - lo))]
                near = covered(len(words), np.maximum(at - (window - half), 0), window - half + 1)
                at, hashes = words.windows(window)
                near = near[at]
                doc, hashes = _distinct(words.doc[at[near]], hashes[near])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), _signed(hashes)], names=["doc_id", "hash"])

    return docs.mapInArrow(batches, "doc_id long, hash long")


def remaining(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """The result, from ``docs(doc_id, text, hashes)`` with the hashes of windows to remove."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo, hi, words in sliced(batch.column(1)):
                lists = batch.column(2).slice(lo, hi - lo)
                at, hashes = words.windows(window)
                gone = covered(len(words), at[_in_own(words, words.doc[at], hashes, lists)], window)
                whole = _in_own(words, np.arange(hi - lo), _whole_hash(words), lists)
                gone |= whole[words.doc]
                kept = [b" ".join([text[a:b] for a, b in zip(start, end)]) for text, start, end in _kept(words, gone)]
                n_words = np.diff(words.first)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n_words),
                           pa.array(np.bincount(words.doc[gone], minlength=hi - lo)),
                           pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                if with_text:
                    columns.append(pa.array([k.decode() for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])])

    return docs.mapInArrow(batches, "doc_id long, n_words long, n_removed long, kept_sha256 string"
                           + (", kept string" if with_text else ""))


def _kept(words: Words, gone: np.ndarray) -> Iterator[tuple[bytes, list[int], list[int]]]:
    data, start, end = words.data.tobytes(), words.start, words.end
    for a, b in zip(words.first[:-1], words.first[1:]):
        k = np.flatnonzero(~gone[a:b]) + a
        yield data, start[k].tolist(), end[k].tolist()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]), one row per row of ``docs``.

    Each word is removed that a window of ``window`` words covers whose word sequence
    also starts in a document with a smaller id.  A null or empty text has no words.  A row
    without id is left whole and removes nothing.  Rows of one id don't remove each other's words.
    Other columns are not read.  Hashes have 64 bits.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    short = materialize(short_windows(known, window), "llm", "windows")
    copies = _repeated(short.select(F.col("whole").alias("hash"), "doc_id")).where("doc_id > first")
    copies = materialize(copies.select("doc_id", "hash").distinct(), "llm", "copies")
    own = short.join(copies.withColumnRenamed("hash", "whole"), ["doc_id", "whole"], "left_anti")
    halves = _repeated(own.select(F.explode("hashes").alias("hash"), "doc_id"))
    dealt = known.repartition(n, "doc_id")  # the one shuffle of texts, for both joins
    full = _repeated(extended(dealt.join(_per_document(halves), "doc_id"), window))
    found = _per_document(full.where("doc_id > first").select("doc_id", "hash").unionByName(copies))
    none = F.array().cast("array<long>")
    return remaining(dealt.join(found, "doc_id", "left").withColumn("hashes", F.coalesce("hashes", none))
                     .unionByName(docs.where("doc_id is null").withColumn("hashes", none)), window, with_text)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}))),
gone AS (SELECT DISTINCT doc_id, i + unnest(range({WINDOW})) AS j FROM g WHERE first < doc_id),
words AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(ws[j], ' ' ORDER BY j) AS t
  FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""
