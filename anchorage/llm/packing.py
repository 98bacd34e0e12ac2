"""Operator 3, best-fit packing after Martello-Toth dominance reduction.

Documents become token ids by a public tokenizer, an end id is added, and only
those longer than a sequence are cut.  Pieces of equal length are exchangeable, so the
instance is the histogram of lengths: at most ``capacity`` counts whatever
the corpus holds.  The plan is made on these counts:

1. reduction: a set of at most three pieces is fixed for good where it dominates
   every other set that could hold its longest piece;
2. best fit in decreasing length packs what remains, whole groups of equal bins at a time.

The plan says, for each length, which sequences and offsets its first, second, ...
piece gets.  Spark ranks the pieces within their length and looks the place up.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.alignment import byte_alphabet
from anchorage.llm.words import Words, raw, slices, span_hash
from anchorage.operators.ranking import with_rank
from anchorage.session import materialize

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
_SLICE = 1 << 20  # bytes of texts handled at once
_KNOWN = 250_000  # different words whose ids a worker remembers
_RANKS = 1 << 42  # more than pieces of one length
#: Bytes of ASCII punctuation but for the apostrophe, which may begin a part with letters.
_PUNCTUATION = np.isin(np.arange(256), [*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
_ALNUM = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LETTERS = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_tables: dict[str, "_Ids"] = {}


def simple(text: bytes) -> bool:
    """Whether the words of a text may be lowered and parted from a tail of signs before they are encoded.

    The tokenizer lowers case after composing characters, so combining marks come first; special tokens keep theirs.
    """
    return b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text


def _letter_encoder(model: dict):
    """Encoder of words of letters by the merges of a vocabulary with word ends: all ids, and how many each word has.

    None if the vocabulary is not of that kind.

    The merges run in one call: a zero byte stands for the word end, and is first joined to
    the last byte of its word, as the vocabulary has it.
    """
    import tiktoken

    end = model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not end:
        return None
    byte, vocabulary = byte_alphabet(), model["vocab"]
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(256)}
    ids = np.zeros(512 + len(model["merges"]), np.int64)
    for c, b in byte.items():
        ids[b], ids[256 + b] = vocabulary[c], vocabulary[c + end]
    for k, merge in enumerate(model["merges"]):
        token = "".join(merge if isinstance(merge, list) else merge.split(" "))
        last = token.endswith(end)
        spelled = bytes(byte[c] for c in (token[: -len(end)] if last else token)) + (b"\0" if last else b"")
        ranks.setdefault(spelled, 512 + k)
        ids[512 + k] = vocabulary[token]
    ends = np.zeros(len(ids), bool)
    ends[[r for t, r in ranks.items() if t.endswith(b"\0")]] = True
    encoding = tiktoken.Encoding("words", pat_str="[^\0]*\0", mergeable_ranks=ranks, special_tokens={})

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = np.array(encoding.encode_ordinary("\0".join(words) + "\0"), np.int64)
        return ids[found], np.diff(np.append(-1, np.flatnonzero(ends[found])))

    return encode


class _Ids:
    """Ids of words, one after the other, for each vocabulary in a worker; kept between its tasks."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            self.of_letters = _letter_encoder(json.load(file)["model"])
        self.clear()

    @classmethod
    def of(cls, name: str) -> "_Ids":
        if name not in _tables:
            _tables[name] = cls(name)
        return _tables[name]

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.start = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # start of each word and the end of the last

    def learn(self, words: list[bytes]) -> None:
        """Add the ids of new words.  Those of plain letters are one part to the tokenizer, so its merges are applied to them at once."""
        texts = [w.decode() for w in words]
        plain = [self.of_letters is not None and bool(_LETTERS.fullmatch(t)) for t in texts]
        some = [t.lower() for t, p in zip(texts, plain) if p]
        if some:
            self._add([w for w, p in zip(words, plain) if p], *self.of_letters(some))
        others = [t for t, p in zip(texts, plain) if not p]
        if others:
            found = [e.ids for e in self.tokenizer.encode_batch(others, add_special_tokens=False)]
            self._add([w for w, p in zip(words, plain) if not p], np.fromiter(chain.from_iterable(found), np.uint32),
                      np.array([len(f) for f in found]))

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.place)
        ends = self.start[n] + np.cumsum(lengths)
        for name, size in (("ids", ends[-1] + 1), ("start", n + len(words) + 1)):
            if (old := getattr(self, name)).size < size:
                grown = np.zeros(2 * size, old.dtype)
                grown[: old.size] = old
                setattr(self, name, grown)
        self.ids[self.start[n]: ends[-1]] = ids
        self.start[n + 1: n + 1 + len(words)] = ends
        self.place.update(zip(words, range(n, n + len(words))))

    def places(self, words: list[bytes]) -> np.ndarray:
        """The places of words in the table; new ones are learned."""
        if len(self.place) > _KNOWN:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        for k in range(0, len(new), 20_000):
            self.learn(new[k: k + 20_000])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, all in one, and the bounds of each text's ids.

        The texts are cut into parts whose ids, one after the other, are the text's: the tokenizer drops white space and never joins
        across it, nor a letter or digit and the signs after it.
        """
        plain = np.fromiter((simple(data[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])), bool, len(bounds) - 1)
        data = _LOWER[data] if plain.all() else np.where(np.repeat(plain, np.diff(bounds)), _LOWER[data], data)
        words = Words(data, bounds)
        solid = np.maximum.accumulate(np.where(_PUNCTUATION[data], -1, np.arange(len(data))))  # last byte up to here that is no sign
        cut = solid[words.end - 1] + 1
        before = np.maximum(cut - 1, 0)
        latin = (data[before - 1] == 0xC3) & (data[before] >= 0x80) & (data[before] != 0x97) & (data[before] != 0xB7)
        cut = np.where(plain[words.doc] & (cut > words.start) & (_ALNUM[data[before]] | latin), cut, words.end)
        # each word, and what follows its cut
        start, end = np.stack([words.start, cut], 1).ravel(), np.stack([cut, words.end], 1).ravel()
        some = start < end
        part_at = np.append(0, np.cumsum(some))[2 * words.first]
        start, end = start[some], end[some]
        # different parts of this slice are looked up once each
        _, first, which = np.unique(span_hash(words.prefix, start, end), return_index=True, return_inverse=True)
        whole = data.tobytes()
        at = self.places([whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])[which]
        length = self.start[at + 1] - self.start[at]
        until = np.cumsum(length)
        out = self.ids[np.repeat(self.start[at] - (until - length), length) + np.arange(length.sum())]
        return out, np.append(0, until)[part_at]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of ``docs(doc_id, text)``."""
    end = np.array([end_id], "<u4").tobytes()
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Ids.of(tokenizer)
        for batch in source:
            data, bounds = raw(batch.column(1))
            for lo, hi in slices(bounds, _SLICE):
                ids, at = table.encode(data[bounds[lo]: bounds[hi]], bounds[lo: hi + 1] - bounds[lo])
                ids, at = memoryview(ids.astype("<u4").tobytes()), (4 * at).tolist()
                rows, ids_of = {k: [] for k in kinds}, []
                for doc_id, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), at, at[1:]):
                    n = (b - a) // 4 + 1
                    for k, first in enumerate(range(0, n, capacity)):
                        own = bytes(ids[a + 4 * first: min(b, a + 4 * (first + capacity))])
                        if first + capacity >= n:
                            own += end
                        for name, value in zip(kinds, (doc_id, k, first, len(own) // 4, zlib.crc32(own))):
                            rows[name].append(value)
                        if with_ids:
                            ids_of.append(np.frombuffer(own, "<i4"))
                columns = [pa.array(rows[k], kind) for k, kind in kinds.items()]
                if with_ids:
                    columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*kinds, *(["ids"] if with_ids else [])])

    return docs.mapInArrow(
        batches, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


Pattern = tuple[int, tuple[tuple[int, int], ...]]  # bins, ((length, pieces of it in each bin), ...)


def _largest(present: list[int], most: int) -> int:
    """The largest present length up to ``most``, 0 if none."""
    k = bisect_left(present, most + 1)
    return present[k - 1] if k else 0


def reduce(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fix dominating sets and take them out of ``counts``.

    A set dominates another if the other's pieces, but for the shared longest one, can be
    put into groups that each fit in the place of one of its own pieces.  For a longest
    piece with ``room`` beside it:

    - nothing fits beside it: alone;
    - a piece of just ``room``, or only ever one piece fits: with the longest that fits;
    - two fit, never three: with one piece at least as long as the best two together, or with the
      two that contain the longest fitting piece, if no pair has a smaller piece above their smaller one.
    """
    fixed: list[Pattern] = []
    present = sorted(counts)

    def take(bins: int, lengths: tuple[int, ...]) -> None:
        fixed.append((bins, tuple((x, lengths.count(x)) for x in dict.fromkeys(lengths))))
        for x in lengths:
            counts[x] -= bins
        for x in set(lengths):
            if not counts[x]:
                del counts[x]
                present.remove(x)

    def others(long: int) -> tuple[int, int, int]:
        """The three smallest pieces beside one of ``long``; capacity + 1 where there is none."""
        found: list[int] = []
        for x in present[:4]:
            found += [x] * min(3, counts[x] - (x == long))
        return tuple((found + [capacity + 1] * 3)[:3])

    def fits(long: int, most: int, but: int = 0) -> int:
        """The longest piece up to ``most`` beside one of ``long`` and one of ``but``."""
        x = _largest(present, most)
        while x and counts[x] - (x == long) - (x == but) <= 0:
            x = _largest(present, x - 1)
        return x

    while True:
        before = len(fixed)
        for long in sorted(counts, reverse=True):
            while counts.get(long):
                room, (a, b, c) = capacity - long, others(long)
                one = fits(long, room)
                if not one:
                    take(counts[long], (long,))
                    continue
                if one == room or a + b > room:
                    take(counts[long] // 2 if one == long else min(counts[long], counts[one]), (long, one))
                    continue
                if a + b + c <= room:
                    break
                pairs = [(x + y, x, y) for x in present if 2 * x <= room and counts[x] - (x == long) > 0
                         and (y := fits(long, room - x, x)) >= x]
                if not pairs or one >= max(pairs)[0]:
                    take(1, (long, one))
                    continue
                small = fits(long, room - one, one)
                if small and max(min(x, y) for _, x, y in pairs) <= small:
                    take(1, (long, one, small))
                    continue
                break
        if len(fixed) == before:
            return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit in decreasing length; equal bins are filled together."""
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(bins: int, pattern: tuple, room: int) -> None:
        if bins:
            if room not in by_room:
                insort(rooms, room)
            by_room.setdefault(room, []).append((bins, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            room = rooms[k] if k < len(rooms) else capacity
            if k < len(rooms):
                bins, pattern = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(k)
            else:
                bins, pattern = left, ()
            each = room // length
            full = min(bins, left // each)
            put(full, (*pattern, (length, each)), room - each * length)
            left, bins = left - full * each, bins - full
            if left and bins:
                put(1, (*pattern, (length, left)), room - left * length)
                left, bins = 0, bins - 1
            if pattern:
                put(bins, pattern, room)
    return [p for group in by_room.values() for p in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """All bins for ``counts`` (length: number of pieces)."""
    left = {k: n for k, n in counts.items() if n}
    return reduce(left, capacity) + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """One row for each length of each pattern: the pieces of that length from rank ``start`` on
    go ``each`` to a sequence, to ``sequence``, ``sequence + 1``, ..., from offset ``base`` on."""
    rows, used, sequence = [], {}, 0
    for bins, items in patterns:
        base = 0
        for length, each in items:
            start = used.get(length, 0)
            rows.append((length * _RANKS + start, start, each, sequence, base))
            used[length] = start + bins * each
            base += length * each
        sequence += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "start", "each", "sequence", "base"), table.T.copy()))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece.

    A null or empty text is the end id alone.  Repeated rows are packed each; a null
    id stays null.  Other columns are not read.  An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = materialize(pieces(docs, capacity, tokenizer, end_id, with_ids), "llm", "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    table = places(plan(counts, capacity))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "__rank"))
            k = np.searchsorted(table["key"], length * _RANKS + rank - 1, "right") - 1
            bin_, place = np.divmod(rank - 1 - table["start"][k], table["each"][k])
            columns = batch.drop_columns(["__rank"])
            yield (columns.append_column("sequence_id", pa.array(table["sequence"][k] + bin_))
                   .append_column("offset", pa.array(table["base"][k] + place * length)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return with_rank(cut, ["doc_id", "piece"], by=["length"], out="__rank").mapInArrow(batches, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence of ``pack_documents(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
