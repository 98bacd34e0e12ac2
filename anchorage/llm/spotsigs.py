"""Operator 6, document fingerprints: SpotSigs.

A signature is a common word (anchor) followed by a chain of the next content
words, common words left out.  A document's fingerprint is the set of its
signatures' hashes; likeness is the Jaccard index of two sets.  Sets are
partitioned by size: sets whose sizes differ by more than the bound allows
can't be as alike as asked for, so only near partitions meet.

The query compares each document with its edited text and with the next
document.  Documents are dealt by id into ordered buckets once; a bucket
also receives the first document of the next one, so every neighbour is at hand
while the rows of a bucket stream by, two documents in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.words import Words, mix, raw

#: Anchors: very common words of English, German, French and Spanish.
ANCHORS = ("the of and to a in is it that was for on are with as be this by from or an at "
           "der die das und ist von den mit zu ein eine nicht auf im als auch "
           "le la les de des et un une est que qui dans pour par du au "
           "el los las y en del se por con para una su al").split()
CHAIN = 2
_LOW_BITS = np.uint64(0xFFFFFFFF)


def _word_hashes(texts: list[bytes], lower: bool = True) -> Words:
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return Words(np.frombuffer(b"".join(texts), np.uint8), bounds, lower)


_anchor_hashes = np.sort(_word_hashes([w.encode() for w in ANCHORS]).hash)


def signature_sets(words: Words, chain: int = CHAIN) -> list[np.ndarray]:
    """For each text the sorted distinct 32-bit hashes of its signatures.

    A text without any signature (no anchor with ``chain`` content words after it)
    has its words themselves instead, so short texts still differ.
    """
    k = np.searchsorted(_anchor_hashes, words.hash)
    anchor = _anchor_hashes[np.minimum(k, len(_anchor_hashes) - 1)] == words.hash
    at, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
    after = np.searchsorted(content, at)
    whole = after + chain <= len(content)
    at, after = at[whole], after[whole]
    whole = words.doc[content[after + chain - 1]] == words.doc[at] if len(at) else np.zeros(0, bool)
    at, after = at[whole], after[whole]
    sig = words.hash[at]
    for j in range(chain):
        sig = mix(sig + words.hash[content[after + j]] * np.uint64(2 * j + 3))
    doc = words.doc[at]
    n_docs = len(words.bounds) - 1
    bare = np.bincount(doc, minlength=n_docs) == 0
    extra = bare[words.doc]
    doc = np.concatenate([doc, words.doc[extra]])
    sig = np.concatenate([sig, mix(words.hash[extra])]) & _LOW_BITS
    both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | sig)
    cuts = np.searchsorted(both, np.arange(1, n_docs, dtype=np.uint64) << np.uint64(32))
    return [part.astype(np.uint32) for part in np.split(both, cuts)] if n_docs else []


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets; two empty sets are alike (1), one empty set is not (0).

    A merge that only looks for the smaller set's members in the larger.
    """
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    if not len(a):
        return 0.0
    k = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[k] == a))
    return both / (len(a) + len(b) - both)


def as_text(sigs: np.ndarray) -> str:
    """A fingerprint as text: base64 of the sorted 32-bit hashes."""
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(doc_id, fingerprint, n_signatures, signatures array<long>), one row per row of ``docs``.

    A null text counts as empty and has an empty fingerprint; ids may be null or repeat.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            data, bounds = raw(batch.column(1))
            for k in range(0, batch.num_rows, 64):
                some = batch.column(0).slice(k, 64)
                own = bounds[k: k + len(some) + 1]
                sets = signature_sets(Words(data[own[0]: own[-1]], own - own[0], True), chain)
                yield pa.RecordBatch.from_arrays(
                    [some, pa.array([as_text(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "fingerprint", "n_signatures", "signatures"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        batches, "doc_id long, fingerprint string, n_signatures long, signatures array<long>")


def alike_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of different fingerprints of ``fingerprints()`` of likeness ``least`` or more.

    Equal fingerprints are one class, named by its text; nonempty classes meet on a shared signature
    among the first of each set that the bound leaves possible (prefix filter), within their own
    or the next size partition, and the size bound is applied before the sets are compared.
    """
    sets = (prints.where("n_signatures > 0").groupBy("fingerprint")
            .agg(F.first("n_signatures").alias("n"), F.first("signatures").alias("sigs")))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least))).cast("int")
    heads = F.slice("sigs", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    keys = sets.select("fingerprint", "n", band.alias("band"), F.explode(heads).alias("sig"))
    left = keys.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    a, b = left.alias("a"), keys.alias("b")
    near = (a.join(b, ["sig", "band"]).where("a.fingerprint <> b.fingerprint")
            .where(F.col("a.n") >= F.col("b.n") * least).where(F.col("b.n") >= F.col("a.n") * least)
            .select(F.least("a.fingerprint", "b.fingerprint").alias("a"), F.greatest("a.fingerprint", "b.fingerprint").alias("b"))
            .distinct())
    both = F.size(F.array_intersect("sa", "sb"))
    return (near.join(sets.select(F.col("fingerprint").alias("a"), F.col("sigs").alias("sa")), "a")
            .join(sets.select(F.col("fingerprint").alias("b"), F.col("sigs").alias("sb")), "b")
            .select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness")).where(F.col("likeness") >= least))


def _bucket(id_col: str, cuts: list[int]):
    """Number of ``cuts`` at or below an id, 0 of a null; searched in two steps."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1

    def below(array):
        return F.size(F.filter(array, lambda c: c <= F.col(id_col)))

    coarse = below(F.array(*map(F.lit, cuts[step - 1::step])))
    fine = below(F.slice(F.array(*map(F.lit, cuts)), coarse * step + 1, F.lit(step)))
    return F.when(F.col(id_col).isNull(), 0).otherwise(coarse * step + fine)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, doc_id, text, guest): ``docs(doc_id, text)`` in order of (doc_id, hash of text) within ordered buckets.

    The last row of a bucket is a guest, the first row of the next bucket; after the last
    bucket comes the first row of all.  Nulls come first.  Buckets end at id quantiles, at most
    ``buckets`` of them; only these bounds and one row for each bucket go through the driver.
    The rows of a bucket are in one partition.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or 2 * parts
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("q"))
    cuts = sorted(set(found.first()["q"] or []))
    dealt = docs.select(_bucket("doc_id", cuts).cast("int").alias("bucket"), "doc_id", "text",
                        F.xxhash64("text").alias("order"))
    row = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "order")
    heads = sorted((r["bucket"], r["head"]["doc_id"], r["head"]["order"])
                   for r in dealt.groupBy("bucket").agg(F.min(row).alias("head")).collect())
    after = [(b, *heads[(k + 1) % len(heads)][1:]) for k, (b, *_) in enumerate(heads)]
    wanted = F.broadcast(spark.createDataFrame(after, "into int, id long, hash long"))
    guests = (dealt.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("order") == F.col("hash")))
              .select(F.col("into").alias("bucket"), "doc_id", "text", "order", F.lit(True).alias("guest"))
              .dropDuplicates(["bucket"]))
    return (dealt.withColumn("guest", F.lit(False)).unionByName(guests)
            .repartition(parts, "bucket")
            .sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "order")
            .select("bucket", "doc_id", "text", "guest"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, and its likeness to both that and the next document.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first
    as many (or all) of the next document's.  The next document is the one that follows by id, then by hash
    of the text; after the last comes the first, so a single document follows itself.  A null text is
    empty.  Repeated rows follow each other; null ids come first; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        """Results of all rows but the last, each with the row after it."""
        own = [(a[1], a[2], b[2]) for a, b in zip(rows, rows[1:]) if not a[3]]
        texts = [text for _, text, _ in own]
        edited = [text[: len(text) - len(text) // 4] + after[: len(text) // 4] for _, text, after in own]
        data = [t.encode() for t in (*texts, *edited, *(after for *_, after in own))]
        sets = signature_sets(_word_hashes(data), chain)
        m = len(own)
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, *_ in own], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(t).hexdigest() for t in data[m:2 * m]], pa.string()),
             pa.array(map(as_text, sets[:m]), pa.string()), pa.array(map(as_text, sets[m:2 * m]), pa.string()),
             pa.array(map(likeness, sets[:m], sets[m:2 * m]), pa.float64()),
             pa.array(map(likeness, sets[:m], sets[2 * m:]), pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in source:
            for k in range(0, batch.num_rows, 64):
                rows += zip(*(c.to_pylist() for c in batch.slice(k, 64).columns))
                yield compared(rows)
                rows = rows[-1:]

    return with_next(docs).mapInArrow(
        batches, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double")


def op6_spotsigs(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
