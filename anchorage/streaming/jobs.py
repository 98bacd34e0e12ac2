"""Streaming jobs (T1, T2): Structured Streaming + ``foreachBatch``.

Each micro-batch is a static DataFrame, so the batch operators (scan,
entries, store overlay) run unchanged inside ``foreachBatch``.  Output is
written to a folder keyed by the batch id, so a retried batch overwrites
its own output.  The refresh job reads only versions older than its batch id, so a retry sees the
state before its first try and counts nothing twice; it reads only the buckets of the records that it was asked
for, writes only the records it changes, and readers take the newest version of each record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.operators.entries import explode_entries, link_entries
from anchorage.operators import store as S
from anchorage.session import shared_dir
from anchorage.sources.pages import read_pages, scan_html


#: Folders by a hash of the source id, so a batch reads those of the records it asks for.
BUCKETS = 64


def _bucket(source_id: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(source_id), F.lit(BUCKETS)), F.lit(0)).cast("int")


def write_version(records: DataFrame, root: str, batch_id: int) -> None:
    """Write ``records`` as the version ``batch_id`` of the store, dealt into buckets; a bucket is written by one task."""
    (records.withColumn("bucket", _bucket("source_id")).repartition(BUCKETS, "bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/batch={batch_id}"))


def newest_records(spark: SparkSession, root: str, before: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """The newest version of every record under ``batch=<id>`` folders, of batches below ``before`` if given.

    ``asked(page_id)``, distinct: only the records of these sources.  Folders of other batches and of buckets without an asked source
    are not read, and rows of other sources go before the newest version is found, a partial aggregate.
    """
    versions = spark.read.parquet(root)
    if before is not None:
        versions = versions.where(F.col("batch") < before)
    if asked is not None:
        buckets = [r[0] for r in asked.select(_bucket("page_id").alias("b")).distinct().collect()]  # BUCKETS rows at most
        versions = (versions.where(F.col("bucket").isin(buckets))
                    .join(asked.select(F.col("page_id").alias("source_id")), "source_id", "left_semi"))
    columns = [c for c in versions.columns if c not in ("batch", "bucket")]
    return versions.groupBy("result_id").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("r.*")


def compact(spark: SparkSession, root: str, into: str) -> None:
    """Write the newest records of ``root`` as the base version of a new store folder ``into``."""
    write_version(newest_records(spark, root), into, -1)


def _file_stream(spark: SparkSession, table: str, **options) -> DataFrame:
    """File stream over ``table`` as batch reads take it: a Parquet file, a folder of such files, or a glob of either."""
    schema = spark.read.parquet(table).schema
    parent, _, name = table.rstrip("/").rpartition("/")
    # braces make a glob of the name: other stream paths must be folders
    return spark.readStream.schema(schema).options(**options).parquet(f"{parent}/{{{name}}}")


def stream_extract(spark: SparkSession, folder: str, name: str = "pages.parquet",
                   out_root: str | None = None) -> DataFrame:
    """New page files -> exploded entries, ``trigger(availableNow=True)``.

    ``name`` in ``folder`` is a page file or a folder of page files.
    """
    out_root = out_root or shared_dir(spark, "stream_extract")
    pages = _file_stream(spark, f"{folder}/{name}")

    def write(batch: DataFrame, batch_id: int) -> None:
        ents = explode_entries(link_entries(scan_html(batch))).drop("page_url", "title")
        ents.write.mode("overwrite").parquet(f"{out_root}/data/batch={batch_id}")

    q = (pages.writeStream.foreachBatch(write)
         .option("checkpointLocation", f"{out_root}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{out_root}/data").drop("batch")


def refresh_batch(spark: SparkSession, batch: DataFrame, batch_id: int, pages: DataFrame, root: str) -> None:
    """Apply one batch of requests (page_id, ts) to the store under ``root``."""
    latest = batch.groupBy("page_id").agg(F.max("ts").alias("_at"), F.count(F.lit(1)).alias("_new"))
    asked = newest_records(spark, root, batch_id, latest.select("page_id")).join(latest, F.col("source_id") == F.col("page_id"))
    fresh = link_entries(scan_html(pages.join(latest.select("page_id"), "page_id", "left_semi"))).select(
        "page_id", *(F.col(c).alias(f"_{c}") for c in ("page_url", "title", "entries")))
    # a record whose page is gone keeps its content
    write_version(asked.join(fresh, "page_id", "left").select(
        "sequence", "result_id", "source_id", *(F.coalesce(f"_{c}", c).alias(c) for c in ("page_url", "title", "entries")),
        F.greatest("refreshed_at", "_at").alias("refreshed_at"), (F.col("n_requests") + F.col("_new")).alias("n_requests")),
        root, batch_id)


def stream_refresh(spark: SparkSession, sf_dir: str, out_root: str | None = None, requests_dir: str | None = None,
                   files_per_batch: int | None = None) -> DataFrame:
    """Refresh requests (events) joined with the pages, upserted into
    the result store; within a batch the latest request per result wins,
    across batches the newer batch overlays the older store version."""
    out_root = out_root or shared_dir(spark, "stream_refresh")
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    n_pages = pages.count()  # one scalar: requests name page event_id % n
    options = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {}
    if requests_dir:
        options["pathGlobFilter"] = "*.parquet"
    events = _file_stream(spark, requests_dir or f"{sf_dir}/events.parquet", **options)
    saved = S.save_results(link_entries(scan_html(pages))).withColumn(
        "refreshed_at", F.lit(None).cast(events.schema["ts"].dataType)).withColumn("n_requests", F.lit(0).cast("bigint"))
    write_version(saved, f"{out_root}/store", -1)

    requests = events.select((F.col("event_id") % F.lit(n_pages)).alias("page_id"), "ts")
    q = (requests.writeStream.foreachBatch(lambda batch, batch_id: refresh_batch(spark, batch, batch_id, pages, f"{out_root}/store"))
         .option("checkpointLocation", f"{out_root}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return newest_records(spark, f"{out_root}/store")
