"""Wrapped links: twelve hrefs per page built from ``pages`` (page_id, url).

The test pages carry only plain ``/word`` anchors, so redirect wrappers,
skipped schemes, opaque schemes, repeated URLs and encoded paths are
derived from each page row with Spark expressions (the same rows
are written in the DuckDB oracle).  The result is a snapshot table
(``pageUrl``, ``title``, ``links``) for ``sources.pages.from_snapshots``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed fixture: (href expression, link text) for k = 0..11.
WRAPPED = (
    ("url", "'Item 0'"),
    ("concat('https://go.example/out?url=', url_encode(url))", "'Item 1'"),
    ("concat('https://go.example/r?x=1#next=', url_encode(url))", "'Item 2'"),
    ("concat('https://go.example/out?to=%2Flocal%2F', CAST(page_id AS STRING))", "'Item 3'"),
    ("'https://go.example/out?u=javascript%3Avoid(0)'", "'Item 4'"),
    ("concat('mailto:p', CAST(page_id AS STRING), '@example.com')", "'Item 5'"),
    ("concat('JavaScript:void(', CAST(page_id AS STRING), ')')", "'Item 6'"),
    ("url", "'Again \"x\", y'"),
    ("concat('https://files.example/a%20b/', CAST(page_id AS STRING), '?q=c%26d,e')", "'Item 8'"),
    # resolves only after a second decoding; names its target twice; a fragment led by '?'
    ("concat('https://go.example/out?url=', url_encode(concat('http://%5B::1%5D/', CAST(page_id AS STRING))))", "'Item 9'"),
    ("concat('https://go.example/out?url=', url_encode(url), '&next=', url_encode(url))", "'Item 10'"),
    ("concat('https://go.example/s#?url=', url_encode(url))", "'Item 11'"),
)


def wrapped_snapshots(pages: DataFrame) -> DataFrame:
    links = ", ".join(
        f"named_struct('domIndex', CAST({k} AS BIGINT), 'rawHref', {h}, 'text', {t})"
        for k, (h, t) in enumerate(WRAPPED))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").alias("pageUrl"),
        F.lit("").alias("title"),
        F.expr(f"array({links})").alias("links"),
    )


def read_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapped_snapshots(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
