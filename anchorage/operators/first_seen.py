"""D2 across runs: a kept index of the first occurrence of every URL.

The index is a folder with one part for each run, ``run=<n>``.  A run reduces its own entries to
one row per URL (partial aggregation, so a URL on every page is one row per task), looks those URLs up among the
earlier runs' URLs and places, of which no other column is read, and writes only what it adds or moves to an earlier
place.  Nothing written before is changed: a run that is tried again reads the runs below it and overwrites its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from anchorage.operators.order import dedup_corpus

_PLACE = ("page_id", "pos")


def add_first_seen(entries: DataFrame, path: str, run: int) -> DataFrame:
    """Merge exploded ``entries(display_url, page_id, pos, ...)`` into the index as run ``run``; returns the rows written.

    Runs are numbered 0, 1, ...; the entries of all runs have the same columns.  A URL is written if no earlier run has
    it or all have it at a later (page_id, pos); at the same place the earlier run's row stays.  Nulls count
    as values, a null place as the first.  A run without entries writes an empty part.
    """
    if run < 0:
        raise ValueError(f"runs are numbered from 0: {run}")
    spark, out = entries.sparkSession, f"{path}/run={run}"
    fresh = dedup_corpus(entries)
    columns, schema = fresh.columns, fresh.schema
    if run:
        held = (spark.read.schema(StructType([*schema, StructField("run", IntegerType())])).parquet(path).where(F.col("run") < run)
                .groupBy(F.col("display_url").alias("_url")).agg(F.min(F.struct(*_PLACE)).alias("_held")))
        fresh = (fresh.join(held, F.col("display_url").eqNullSafe(F.col("_url")), "left")
                 .where(F.col("_held").isNull() | (F.struct(*_PLACE) < F.col("_held"))).select(*columns))
    fresh.write.mode("overwrite").parquet(out)
    return spark.read.schema(schema).parquet(out)


def first_seen(spark: SparkSession, path: str) -> DataFrame:
    """The index: one row per URL, that of the least (page_id, pos) of all runs, the earliest run's at equal places."""
    parts = spark.read.parquet(path)
    columns = [c for c in parts.columns if c not in ("display_url", "run")]
    return (parts.groupBy("display_url").agg(F.min_by(F.struct(*columns), F.struct(*_PLACE, "run")).alias("_f"))
            .select("display_url", *(F.col(f"_f.{c}").alias(c) for c in columns)))


def compact_first_seen(spark: SparkSession, path: str, into: str) -> None:
    """Write the index as run 0 of the new index ``into``; its next run is 1."""
    first_seen(spark, path).write.mode("overwrite").parquet(f"{into}/run=0")
