"""Operator 4, n-gram Jaccard join: parity sketches.

A sketch XORs a document's shingles, by hash, into cells.  Shingles that two documents
share cancel out in the XOR of their sketches, so the number of cells that differ is
never above the size of the sets' symmetric difference.  For sets of a size band that
bound is at most d for any linked pair; sketches of more than d cells therefore agree in one (pigeonhole),
and documents meet on (band, cell, value).  Cells hold 64-bit XORs for that join;
a second sketch of single bits gives the Hamming distance that prunes candidates before
the texts are compared.

Exactness: a linked pair agrees in a nonempty cell whenever one of the two has more than d
nonempty cells.  Documents that have not (rare) also meet on the shingles of their prefix
filter.  No candidate is capped.

Copies are one class, named by its least id, before anything is joined.  Around each key only
the star to its least document is compared first.  That document is found among the least ones of each task, and handed to
the rows of each task by these, so that a key of a third of all rows is no single group.  Once linked documents are one
component, only pairs across components that still share a key are, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorage.llm.graph import components
from anchorage.llm.words import Words, mix, seeded, sliced
from anchorage.session import materialize, small_batches

SHINGLE = 4
PERCENT = 85
#: Size bound of the one broadcast: classes of copies, the largest ones.
MOST_CLASSES = 100_000
BLOCK = 2048
_FLUSH = 500_000
_U = np.uint64
_SEED = seeded(4, 4)


def bands(percent: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least sizes of the bands, and for each: the largest symmetric difference of a linked pair whose
    smaller set is in it, and the number of cells (0 where only equal sets link)."""
    low = np.unique(np.ceil(np.sqrt(2.0) ** np.arange(0, int(2 * np.log2(most)))).astype(np.int64))
    high = np.append(low[1:] - 1, most)
    differ = (high + 100 * high // percent) * (100 - percent) // (100 + percent)
    return low, differ, np.where(differ > 0, differ + 8 + differ // 16, 0)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, sorted; a document of fewer words has its whole sequence as one."""
    at, hashes = words.windows(k)
    doc = words.doc[at]
    n_words = np.diff(words.first)
    few = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(few):
        short = np.array([_whole(words, d) for d in few], _U)
        doc, hashes = np.concatenate([doc, few]), np.concatenate([hashes, short])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def _whole(words: Words, d: int) -> np.uint64:
    out = _SEED[3:].copy()
    for h in words.hash[words.first[d]: words.first[d + 1]]:
        out = mix(out * _U(3) + h)
    return out[0]


def set_hash(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """A hash of each document's set, 0 of an empty one."""
    starts = np.searchsorted(doc, np.arange(n_docs + 1))
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(mix(hashes ^ _SEED[0]), out=total[1:])
    sums = total[starts[1:]] - total[starts[:-1]]
    return np.where(starts[1:] > starts[:-1], mix(sums), _U(0))


def bit_sketch(hashes: np.ndarray) -> bytes:
    """Parity bits of a set: as many bits as the power of two from twice to four times its size, 64 at least."""
    size = max(64, 1 << int(2 * max(1, len(hashes)) - 1).bit_length())
    place = (mix(hashes ^ _SEED[1]) & _U(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=size) & 1).astype(bool), bitorder="little").tobytes()


def half(sketch: bytes) -> bytes:
    """A sketch folded by XOR to half its bits, 64 at least; distances only shrink."""
    n = len(sketch) // 2
    if n < 8:
        return sketch
    return (int.from_bytes(sketch[:n], "little") ^ int.from_bytes(sketch[n:], "little")).to_bytes(n, "little")


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two bit sketches; the longer is folded by XOR to the shorter's size."""
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a)
    if len(a) < len(b):
        x, y, n = y, x, len(b)
    least = min(len(a), len(b))
    while n > least:
        n //= 2
        x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
    return (x ^ y).bit_count()


def may_link(na: int, nb: int, a: bytes, b: bytes, percent: int) -> bool:
    """Whether sizes and bit sketches allow a link."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    return distance(a, b) * (100 + percent) <= (na + nb) * (100 - percent)


def cell_keys(doc: np.ndarray, hashes: np.ndarray, n_docs: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of every nonempty cell of the sketches of the bands a document takes part in."""
    low, differ, cells = bands(percent)
    size = np.bincount(doc, minlength=n_docs)
    own = np.searchsorted(low, np.maximum(size, 1), "right") - 1
    out_doc, out_key = [], []
    for step in (0, 1):  # its own band, and as the larger set of a pair the band below
        band = own - step
        ok = (band >= 0) & (size > 0)
        band = np.maximum(band, 0)
        if step:
            ok &= size <= 100 * (low[band + 1] - 1) // percent
        ok &= cells[band] > 0
        pick = ok[doc]
        d, h = doc[pick], hashes[pick]
        if not len(d):
            continue
        value = mix(h ^ _SEED[2])
        cell = ((mix(value) >> _U(32)) * cells[band[d]].astype(_U)) >> _U(32)
        group = (d.astype(_U) << _U(32)) | cell
        order = np.argsort(group)
        group = group[order]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        xor = np.bitwise_xor.reduceat(value[order], start)
        group = group[start]
        d = (group >> _U(32)).astype(np.int64)
        out_doc.append(d)
        out_key.append(mix(xor ^ mix((band[d].astype(_U) << _U(33)) | (group & _U(0xFFFFFFFF)))))
        # documents with too few nonempty cells also meet on their prefix filter
        few = np.flatnonzero(ok & (np.bincount(d, minlength=n_docs) <= differ[band]))
        for x in few:
            h = hashes[np.searchsorted(doc, x): np.searchsorted(doc, x + 1)]
            first = h[: len(h) - -(-percent * len(h) // 100) + 1]
            out_doc.append(np.full(len(first), x))
            out_key.append(mix(first ^ mix((band[x: x + 1].astype(_U) << _U(33)) | _U(1 << 32))))
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(out_doc), np.concatenate(out_key)


def measured(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set, sketch, half) of every row; ``set`` is null of an empty one."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo, hi, words in sliced(batch.column(1), lower=True):
                doc, hashes = shingle_sets(words, k)
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                size = np.diff(bounds)
                sketches = [bit_sketch(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size),
                     pa.array(set_hash(doc, hashes, hi - lo).view(np.int64), mask=size == 0),
                     pa.array(sketches, pa.binary()), pa.array(map(half, sketches), pa.binary())],
                    names=["doc_id", "n_shingles", "set", "sketch", "half"])

    return docs.mapInArrow(batches, "doc_id long, n_shingles long, set long, sketch binary, half binary")


def keyed(docs: DataFrame, k: int, percent: int, classes: DataFrame) -> DataFrame:
    """(key, doc_id, near, many) of the documents, but for copies in the ``classes(set, doc)`` that aren't ``doc``.

    Rows that share a key within a task are combined there, ``_FLUSH`` keys at a time: ``near`` is the least
    document among them, null of that document itself, and ``many`` whether there are others.
    """
    table = classes.toArrow()
    order = np.argsort(table.column("set").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(
        tuple(np.ascontiguousarray(table.column(c).to_numpy()[order]) for c in ("set", "doc")))

    def combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, doc = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[once], doc[once]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        least = doc[start[group]] if len(key) else doc
        many = np.diff(np.append(start, len(key)))[group] > 1 if len(key) else new
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(least, mask=doc == least), pa.array(many)],
                                          names=["key", "doc_id", "near", "many"])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, firsts = shared.value
        parts, held = [], 0
        for batch in source:
            for lo, hi, words in sliced(batch.column(1), lower=True):
                ids = np.asarray(batch.column(0).slice(lo, hi - lo))
                doc, hashes = shingle_sets(words, k)
                own = set_hash(doc, hashes, hi - lo).view(np.int64)
                if len(sets):
                    at = np.minimum(np.searchsorted(sets, own), len(sets) - 1)
                    copy = (sets[at] == own) & (firsts[at] != ids)
                    keep = ~copy[doc]
                    doc, hashes = doc[keep], hashes[keep]
                doc, key = cell_keys(doc, hashes, hi - lo, percent)
                parts.append((key.view(np.int64), ids[doc]))
                held += len(key)
                if held > _FLUSH:
                    yield combined(parts)
                    parts, held = [], 0
        yield combined(parts)

    return docs.mapInArrow(batches, "key long, doc_id long, near long, many boolean")


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose sizes and bit sketches allow a link.

    Most pairs go by half sketches, so whole ones are moved for few.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            a, b, na, sa, nb, sb = (c.to_pylist() for c in batch.columns)
            keep = [may_link(*x, percent) for x in zip(na, nb, sa, sb)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for sketch in ("half", "sketch"):
        for side in "ab":
            pairs = pairs.join(sketches.select(F.col("doc").alias(side), F.col("n").alias(f"n{side}"),
                                               F.col(sketch).alias(f"s{side}")).hint("merge"), side)
        pairs = pairs.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(batches, "a long, b long")
    return pairs


def dealt(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(key, x, y, seeks, outside, doc, component, n, sketch): the groups (key, x, y) in which documents of
    rows(key, doc, component) meet that share a key and are in different components.

    Sketches are joined only to the rows of keys that hold several components.  There, rows outside the
    key's largest component (they seek) meet all of its rows, each side dealt into blocks: a group
    has at most about two blocks' rows.
    """
    several = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    rows = materialize(rows.join(several, "key", "left_semi"), "llm", "across")
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main"))
    rows = (rows.join(sizes, "key").withColumn("outside", F.col("component") != F.col("main.component"))
            .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
            .withColumn("others", F.ceil((F.col("size") - F.col("main.n")) / BLOCK).cast("int"))
            .join(sketches, "doc"))
    own, other = (F.pmod(F.xxhash64("doc"), n).cast("int") for n in ("blocks", "others"))
    met = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda y: F.struct(own.alias("x"), y.alias("y"), F.lit(False).alias("seeks")))
    seeks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("x"), other.alias("y"), F.lit(True).alias("seeks")))
    return (rows.withColumn("at", F.explode(F.when(F.col("outside"), F.concat(met, seeks)).otherwise(met)))
            .select("key", "at.x", "at.y", "at.seeks", "outside", "doc", "component", "n", "sketch"))


def _across(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of the ``dealt`` groups whose sketches allow a link."""
    rows = dealt(rows, sketches)

    def compared(group: list[tuple]) -> Iterator[tuple[int, int]]:
        all_rows = [r[4:] for r in group if not r[3]]
        for *_, a, ca, na, sa in (r for r in group if r[3]):
            for outside, b, cb, nb, sb in all_rows:
                # two rows outside meet twice, and are compared once
                if ca != cb and not (outside and b < a) and may_link(na, nb, sa, sb, percent):
                    yield min(a, b), max(a, b)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in source:
            found: set[tuple[int, int]] = set()
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][:3] != row[:3]:
                    found.update(compared(group))
                    group = []
                group.append(row)
            yield _pairs(found)
        yield _pairs(set(compared(group)) if group else set())

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(batches, "a long, b long").distinct()


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``pairs(a, b)`` with 100 * intersection >= percent * union of the texts' shingle sets."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo in range(0, batch.num_rows, 16):
                some = batch.slice(lo, 16)
                keep = []
                texts = pa.concat_arrays([some.column(2), some.column(3)])
                sets: list[np.ndarray] = []
                for x, y, words in sliced(texts, lower=True):
                    doc, hashes = shingle_sets(words, k)
                    sets += np.split(hashes, np.searchsorted(doc, np.arange(1, y - x)))
                for i in range(some.num_rows):
                    a, b = sets[i], sets[i + some.num_rows]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
                yield some.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs, "llm", "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = materialize(docs.join(needed, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "text").distinct(), "llm", "texts")
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("doc").alias(side), F.col("text").alias(f"t{side}")), side)
    return materialize(pairs.select("a", "b", "ta", "tb").mapInArrow(batches, "a long, b long").distinct(), "llm", "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    ``component_id`` is the least id reachable over links.  A null or empty text has no
    shingles and is linked with nothing.  Rows of one id are one vertex.  A row without id is linked with nothing and has
    no component.  Other columns are not read.  Sets are compared by 64-bit hashes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return _components_of(docs, k, percent)


def _components_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    known = docs.where("doc_id is not null")
    rows = materialize(measured(docs, k), "llm", "sets")
    full = rows.where("doc_id is not null and set is not null")
    classes = materialize(full.groupBy("set").agg(
        F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"),
        F.first("sketch").alias("sketch"), F.first("half").alias("half")), "llm", "classes")
    largest = classes.where("copies > 1").orderBy(F.col("copies").desc(), "set").limit(MOST_CLASSES).select("set", "doc")

    # rows that met their key's least document of the task are spread by id, only the others meet by key alone
    by_key = Window.partitionBy("key", F.when(F.col("near").isNotNull(), F.col("doc_id")))
    met = materialize(
        keyed(known, k, percent, largest)
        .select("key", F.col("doc_id").alias("doc"), "near", "many", F.min("doc_id").over(by_key).alias("first"),
                F.max("doc_id").over(by_key).alias("last"))
        .where("many or first < last").drop("last"), "llm", "met")
    # the least document of all reaches them through that of their task, which at most _FLUSH rows name
    tops = met.where("near is null and many").groupBy("key", F.col("doc").alias("near")).agg(F.min("first").alias("first"))
    shared = materialize(
        met.where("near is not null").select("key", "near", "doc").join(tops, ["key", "near"]).select("key", "doc", "first")
        .unionByName(met.where("near is null").select("key", "doc", "first")), "llm", "shared")
    # one document stands for its class; rows of one id in several classes tie these together
    members = full.select("doc_id", "set").distinct().join(classes.select("set", "doc"), "set").select("doc_id", "doc").distinct()
    ties = members.groupBy("doc_id").agg(F.min("doc").alias("b"), F.max("doc").alias("a")).where("a <> b")
    ties = members.join(ties.select("doc_id", "b"), "doc_id").select(F.col("doc").alias("a"), "b").where("a <> b")
    sketches = classes.select("doc", "n", "sketch", "half")

    stars = shared.where("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b")).distinct()
    stars = _near(stars, sketches, percent).groupBy("a").agg(F.min("b").alias("b"))
    links = _linked(stars, known, k, percent).unionByName(ties)
    found = components(links)
    labelled = (shared.join(found.withColumnRenamed("node", "doc"), "doc", "left").join(sketches.select("doc"), "doc", "left_semi")
                .withColumn("component", F.coalesce("component", "doc")).select("key", "doc", "component").distinct())
    rest = _linked(_across(labelled, sketches.select("doc", "n", "sketch"), percent), known, k, percent)
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))
    return (rows.join(classes.select("set", "doc"), "set", "left")
            .join(found.select(F.col("node").alias("doc"), "component"), "doc", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc", "doc_id").alias("component_id")))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n2
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * n2 >= {PERCENT} * (x.n + y.n - n2)),
r AS (
  SELECT doc_id AS a, doc_id AS c FROM w
  UNION
  SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = w.doc_id"""
