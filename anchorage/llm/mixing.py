"""Operator 2, mixing sources to target weights: systematic sampling.

Every document of a source has the same expected number of copies, its
source's target over its size.  Along the source's documents, ordered by
size and id, expected copies are summed up from one random offset; a document is emitted
once for every whole number that the sum passes at it.  Because the order is by
size, a source's taken words are off its target by about one document.

All is DataFrame code.  The prefix sum of equal steps is a rank, which
``with_rank`` gives without a single-task window, however large a source is.
Only the table of sources, one row each, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorage.operators.ranking import with_rank
from anchorage.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 7
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def offset_of(seed: int) -> float:
    """The random offset, in [0, 1)."""
    return (seed * 0.6180339887498949 + 0.25) % 1


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes(no_source, source, source_size)`` plus ``target``.

    The water level is the largest, over the sources filled first, of what is
    left to share by the weights of the rest: filling the k sources of lowest
    limit to weight ratio and sharing the remainder can only overstate a level
    that is too low for one of the others.
    """
    place = F.row_number().over(Window.orderBy("no_source", "source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    sizes = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", most * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "no_source", "source")
    whole = Window.partitionBy(F.lit(0)).rowsBetween(*_ALL)
    sizes = (sizes
             .withColumn("filled", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(_ALL[0], -1)), F.lit(0.0)))
             .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, _ALL[1])))
             .withColumn("all", F.sum("source_size").over(whole)))
    level = F.max((share * F.col("all") - F.col("filled")) / F.col("rest")).over(whole)
    return (sizes.withColumn("level", level)
            .select("no_source", "source", "source_size",
                    F.least(F.col("limit"), F.col("level") * F.col("weight")).alias("target")))


def with_copies(docs: DataFrame, size, id_col: str, source_col: str, seed: int, ties: list[str]) -> DataFrame:
    """``docs`` plus ``__size``, ``__source_size``, ``__target`` and ``__copies``; rows of one size and id are ordered by ``ties``."""
    docs = docs.select("*", size.alias("__size"), F.col(source_col).isNull().alias("__no_source"),
                       F.coalesce(F.col(source_col), F.lit("")).alias("__source"))
    ranked = with_rank(docs, ["__size", id_col, *ties], by=["__no_source", "__source"], out="__rank")
    totals = ranked.groupBy(F.col("__no_source").alias("no_source"), F.col("__source").alias("source")).agg(
        F.sum("__size").alias("source_size"))
    targets = source_targets(totals).select(
        F.col("no_source").alias("__no_source"), F.col("source").alias("__source"),
        F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    each = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    passed = [F.floor(F.lit(offset_of(seed)) + each * (F.col("__rank") - k)) for k in (0, 1)]
    return (ranked.join(targets, ["__no_source", "__source"])
            .withColumn("__copies", F.least(passed[0] - passed[1], F.lit(MOST)).cast("int"))
            .drop("__no_source", "__source", "__rank"))


def size_of(text_col: str):
    """Number of words; 0 of a null."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``.

    A null text has size 0; a null source is a source of its own, the last one; an empty
    source is not null.  Repeated rows count as documents of their own; rows of one size and id are ordered by
    a hash of the text.  A source without words has target 0 and nothing is taken from it.  Equal input and seed give equal results.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), size_of(text_col).alias("size"),
                       F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("hash"))
    return (with_copies(docs, F.col("size"), "doc_id", "source", seed, ["hash"])
            .select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                    (F.col("__copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns as they are, each as often as it is taken.

    Only sizes, ids and sources are ranked; the texts are written once, with a number for each row, and move once, to meet their copies.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "llm", "rows")
    narrow = rows.select("__row", F.col(id_col).alias("__id"), size_of(text_col).alias("size"), F.col(source_col).alias("__from"),
                         F.xxhash64(text_col).alias("__hash"))
    copies = with_copies(narrow, F.col("size"), "__id", "__from", seed, ["__hash"]).where("__copies > 0").select("__row", "__copies")
    return (rows.join(copies.hint("merge"), "__row")
            .withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))))
            .select(*docs.columns))


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, {MOST}.0::DOUBLE * source_size AS cap,
         coalesce(sum({MOST}.0::DOUBLE * source_size) OVER (
           ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s),
l AS (SELECT max(({SHARE}::DOUBLE * (SELECT sum(source_size) FROM s) - filled) / rest) AS level FROM f),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM f, l),
r AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
         row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * least({MOST}, floor({offset_of(SEED)!r}::DOUBLE + each * k)
                        - floor({offset_of(SEED)!r}::DOUBLE + each * (k - 1)))::BIGINT AS taken
FROM r"""
