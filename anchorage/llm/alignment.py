"""Operator 11, alignment of two tokenizers: lockstep vectorised merging.

A text is encoded by a byte-level vocabulary A (with a space before it) and by a
piece vocabulary B (which adds that space itself).  Both give a row of byte
offsets at which tokens end.  A and B tokens that end at one offset are linked, and
those offsets cut both rows into groups.

The offsets of all documents of a slice are merged at once: one numpy state
vector holds the A and the B pointer of every lane; each step compares what they point at,
emits links and cuts where both end together, advances the pointers that are behind and
drops the lanes that are through.  A lane is a document, or a stretch of ``LANE`` bytes of a long one:
tokens are linked by their ends alone, so stretches don't depend on each other, and a
long text takes as few steps as the others.

How often a pair of ids is linked in the corpus is counted over all documents: once per document in
the tasks, then by Spark.  The commonest ``HELD`` pairs are looked up in the tasks; all others are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.words import raw, slices
from anchorage.session import materialize

A_VOCABULARY = "byte_bpe_50k.json"
B_VOCABULARY = "piece_bpe_32k.model"
LANE = 2048  # bytes of a text that one pair of pointers walks
HELD = 1 << 20  # pairs held in each task, of 16 bytes; the rest is joined
SLICE_BYTES = 1 << 20
#: Runs of white space from this length on overflow the stack of the fast encoder.
_LONG_BLANKS = re.compile(r"\s{4000}")
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
_tools: dict[tuple[str, str], "Tokenizers"] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes.

    Printable bytes of Latin-1 stand for themselves, the others, in order, for the code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """Bytes of each token of a vocabulary: ``data[start[id]: start[id] + length[id]]``."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``, joined."""
        length = self.length[ids]
        shift = self.start[ids] - (np.cumsum(length) - length)
        return self.data[np.repeat(shift, length) + np.arange(length.sum())]


class Tokenizers:
    """Both encoders of a worker, loaded once."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.a_file = public_tokenizers.path(a)
        with open(self.a_file, encoding="utf-8") as file:
            whole = json.load(file)
        byte, vocabulary = byte_alphabet(), whole["model"]["vocab"]
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        entry = {i: bytes(byte[c] for c in s) for s, i in vocabulary.items() if s not in special}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                      mergeable_ranks={t: i for i, t in entry.items()})
        self.plain = None
        self.a = Side([entry.get(i, b"") for i in range(max([*entry, *special.values()]) + 1)])
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        self.b = Side([self._piece(i) for i in range(self.pieces.get_piece_size())])

    @classmethod
    def of(cls, a: str, b: str) -> "Tokenizers":
        if (a, b) not in _tools:
            _tools[a, b] = cls(a, b)
        return _tools[a, b]

    def _piece(self, i: int) -> bytes:
        if self.pieces.is_control(i) or self.pieces.is_unknown(i):
            return b""
        piece = self.pieces.id_to_piece(i)
        byte = _BYTE_PIECE.fullmatch(piece) if self.pieces.is_byte(i) else None
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        """Ids of space + text; special tokens' strings are plain text."""
        if not _LONG_BLANKS.search(text):
            return self.fast.encode_ordinary(" " + text)
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.a_file)
            self.plain.encode_special_tokens = True
        return self.plain.encode(" " + text, add_special_tokens=False).ids

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values, and the bounds of the rows."""
    bounds = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=bounds[1:])
    return np.fromiter(chain.from_iterable(rows), np.int64, bounds[-1]), bounds


def lockstep(a_end: np.ndarray, b_end: np.ndarray, i: np.ndarray, a_stop: np.ndarray, j: np.ndarray,
             b_stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of each step: positions in ``a_end`` and ``b_end`` that hold the same offset.

    A lane's pointers start at ``i`` and ``j`` and run up to ``a_stop`` and ``b_stop``.
    """
    live = (i < a_stop) & (j < b_stop)
    while live.any():
        if not live.all():
            i, a_stop, j, b_stop = i[live], a_stop[live], j[live], b_stop[live]
        x, y = a_end[i], b_end[j]
        same = x == y
        yield i[same], j[same]
        i, j = i + (x <= y), j + (y <= x)
        live = (i < a_stop) & (j < b_stop)


def links_of(a_end: np.ndarray, b_end: np.ndarray, bounds: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """All links in order: positions in ``a_end`` and in ``b_end``, ascending offsets over all
    documents, whose bytes are ``bounds[d]`` to ``bounds[d + 1]``."""
    stretches = -(-np.diff(bounds) // lane)
    first = np.repeat(bounds[:-1], stretches)
    low = first + lane * (np.arange(len(first)) - np.repeat(np.cumsum(stretches) - stretches, stretches))
    high = np.minimum(low + lane, np.repeat(bounds[1:], stretches))
    at = [np.searchsorted(end, offsets, "right") for end in (a_end, b_end) for offsets in (low, high)]
    found = [*lockstep(a_end, b_end, *at)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(side) for side in zip(*found))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def groups_text(a_ids: np.ndarray, b_ids: np.ndarray, a_link: np.ndarray, b_link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` as bytes, and the end of each group's bytes.  The last tokens of a group are linked."""
    a_at, b_at = np.arange(len(a_ids)), np.arange(len(b_ids))
    a_group, b_group = np.searchsorted(a_link, a_at), np.searchsorted(b_link, b_at)
    ids, mark = np.zeros(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
    a_place, b_place = a_at + np.append(0, b_link + 1)[a_group], b_at + (a_link + 1)[b_group]
    ids[a_place], ids[b_place] = a_ids, b_ids
    mark[a_place[a_link]], mark[b_place[b_link]] = ord("|"), ord(";")
    digits = np.ones(len(ids), np.int64)
    for power in range(1, len(str(ids.max(initial=0)))):
        digits += ids >= 10 ** power
    end = np.cumsum(digits + 1)
    out = np.empty(end[-1] if len(end) else 0, np.uint8)
    out[end - 1] = mark
    place = end - 2
    while len(ids):
        out[place] = ord("0") + ids % 10
        ids, place = ids // 10, place - 1
        more = ids > 0
        ids, place = ids[more], place[more]
    return out, end[b_place[b_link]]


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between ``bounds``."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))


def _align(column: pa.Array, tools: Tokenizers, lane: int, tokens: bool) -> Iterator[tuple[int, int, dict[str, pa.Array]]]:
    data, bounds = raw(column)
    for lo, hi in slices(bounds, SLICE_BYTES):
        texts = [t.as_py() or "" for t in column.slice(lo, hi - lo)]
        size = np.diff(bounds[lo: hi + 1])
        own = data[bounds[lo]: bounds[hi]]
        # a space before each text
        spaced = np.insert(own, (bounds[lo:hi] - bounds[lo]), 0x20) if len(own) else np.full(len(texts), 0x20, np.uint8)
        spaced_bounds = np.append(0, np.cumsum(size + 1))
        right, sides = size > 0, []
        for side, rows in ((tools.a, [tools.encode_a(t) if t else [] for t in texts]), (tools.b, tools.encode_b(texts))):
            ids, at = flat(rows)
            right &= _per_row(side.length[ids], at) == size + 1
            sides.append([side, ids, at])
        differ = np.zeros(len(texts), bool)
        for side, ids, at in sides:  # bytes are compared where there are as many
            keep = np.repeat(right, np.diff(at))
            inner = np.repeat(right, size + 1)
            wrong = side.spelled(ids[keep]) != spaced[inner]
            differ[right] |= _per_row(wrong, np.append(0, np.cumsum((size + 1)[right]))) > 0
        right &= ~differ
        for k, (side, ids, at) in enumerate(sides):
            sides[k] = (ids[np.repeat(right, np.diff(at))], np.append(0, np.cumsum(np.diff(at) * right)))
        (a_ids, a_at), (b_ids, b_at) = sides
        ends = np.append(0, np.cumsum((size + 1) * right))
        a_end, b_end = np.cumsum(tools.a.length[a_ids]), np.cumsum(tools.b.length[b_ids])
        a_link, b_link = links_of(a_end, b_end, ends, lane)
        link_at = np.searchsorted(a_link, a_at)
        written, group_end = groups_text(a_ids, b_ids, a_link, b_link)
        text_at = np.append(0, group_end)[link_at]
        view = memoryview(written)
        doc = np.repeat(np.arange(len(texts)), np.diff(link_at))
        n_b = len(tools.b.length)
        pair, times = np.unique((doc * len(tools.a.length) + a_ids[a_link]) * n_b + b_ids[b_link], return_counts=True)
        of, key = np.divmod(pair, len(tools.a.length) * n_b)
        pair_at = np.searchsorted(of, np.arange(len(texts) + 1))
        columns = {
            "n_a": pa.array(np.diff(a_at)), "n_b": pa.array(np.diff(b_at)),
            "n_groups": pa.array(np.diff(link_at)), "n_links": pa.array(np.diff(link_at)),
            "groups_sha256": pa.array([hashlib.sha256(view[p: q - 1]).hexdigest() if q > p else ""
                                       for p, q in zip(text_at[:-1], text_at[1:])], pa.string()),
            "pairs": _lists(key, pair_at, pa.int64()), "times": _lists(times, pair_at, pa.int32())}
        if tokens:
            columns |= {
                "a_ids": _lists(a_ids, a_at, pa.int32()), "b_ids": _lists(b_ids, b_at, pa.int32()),
                "cuts": _lists(a_end[a_link] - ends[doc], link_at, pa.int64()),
                "a_linked": _lists(a_link - a_at[doc], link_at, pa.int64()),
                "b_linked": _lists(b_link - b_at[doc], link_at, pa.int64())}
        yield lo, hi, columns


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A_VOCABULARY,
                    b: str = B_VOCABULARY, lane: int = LANE, tokens: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, a_ids, b_ids, cuts, a_linked, b_linked]).

    ``pairs`` holds the distinct linked pairs as id of A times size of B plus id of B, ``times`` how often each is linked.  With
    ``tokens``: the ids, the byte offsets in space + text that cut them into groups, and the positions of the tokens of each link.
    A null or empty text, or one that the tokens of a side don't spell byte for byte, has no tokens: zeros, '' and
    empty arrays.  A very long text is one slice of a task.  Repeated rows are rows of their own, a null id
    stays null, other columns are not read; an empty table gives no rows.
    """
    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    if tokens:
        fields += ", a_ids array<int>, b_ids array<int>, cuts array<long>, a_linked array<long>, b_linked array<long>"

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Tokenizers.of(a, b)
        for batch in source:
            for lo, hi, columns in _align(batch.column(1), tools, lane, tokens):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns.values()],
                                                 names=["doc_id", *columns])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(batches, fields)


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column without nulls."""
    bounds = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[bounds[0]: bounds[-1]], bounds - bounds[0]


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): how many links hold each pair, over all documents; whether none of its B id's pairs has more."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            (keys, _), (times, _) = _arrays(batch.column(0)), _arrays(batch.column(1))
            pair, of = np.unique(keys, return_inverse=True)
            count = np.zeros(len(pair), np.int64)
            np.add.at(count, of, times)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], names=["pair", "count"])

    pairs = materialize(aligned.select("pairs", "times").mapInArrow(batches, "pair long, count long")
                        .groupBy("pair").agg(F.sum("count").alias("count")), "llm", "pairs")
    pairs = pairs.withColumn("b", F.expr(f"pair % {n_b}"))
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most.hint("merge"), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_pair_counts(aligned: DataFrame, n_b: int, held: int = HELD) -> DataFrame:
    """``aligned`` plus ``n_best`` and ``count_sum`` instead of its arrays.

    ``n_best``: links whose pair is the most frequent one of its B id, ties included; ``count_sum``: the counts of all links' pairs, summed up.
    """
    aligned = materialize(aligned.withColumn("__row", F.monotonically_increasing_id()), "llm", "aligned")
    counted = materialize(pair_counts(aligned, n_b), "llm", "counted")
    rare = None
    if (n := counted.count()) <= held:
        common = counted
    else:  # the commonest ones; ties by the pair
        common = materialize(counted.orderBy(F.desc("count"), "pair").limit(held), "llm", "common")
        last = common.orderBy("count", F.desc("pair")).first()
        rare = counted.where((F.col("count") < last["count"]) | ((F.col("count") == last["count"]) & (F.col("pair") > last["pair"])))
    table = common.toArrow().sort_by("pair")  # ``held`` rows at most
    known, count, best = (table[c].to_numpy() for c in ("pair", "count", "best"))
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)

    def looked_up(batch: pa.RecordBatch):
        place = batch.schema.get_field_index
        (keys, bounds), (times, _) = (_arrays(batch.column(place(c))) for c in ("pairs", "times"))
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        return keys, bounds, times, at, known[at] == keys if len(known) else np.zeros(len(keys), bool)

    def sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys, bounds, times, at, hit = looked_up(batch)
            own = np.where(hit, times, 0)
            n_best, total = (_per_row(own * v[at], bounds) if len(known) else np.zeros(batch.num_rows, np.int64)
                             for v in (best, count))
            yield (batch.select(kept).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total)))

    result = aligned.mapInArrow(sums, fields + ", n_best long, count_sum long")
    if rare is None:
        return result.drop("__row")

    def others(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys, bounds, times, _, hit = looked_up(batch)
            row = np.repeat(np.asarray(batch.column(batch.schema.get_field_index("__row"))), np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(v[~hit]) for v in (row, keys, times.astype(np.int64))],
                                             names=["__row", "pair", "times"])

    left = (aligned.select("__row", "pairs", "times").mapInArrow(others, "__row long, pair long, times long")
            .join(rare.hint("merge"), "pair")
            .groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                  F.sum(F.col("times") * F.col("count")).alias("more_sum")))
    return (result.join(left, "__row", "left")
            .withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
                          "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
            .drop("__row", "more_best", "more_sum"))


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    n_b = len(Tokenizers.of(A_VOCABULARY, B_VOCABULARY).b.length)
    return with_pair_counts(align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), n_b).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
