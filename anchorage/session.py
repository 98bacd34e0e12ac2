"""Session helpers: a local session for tests/bench and the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used when ``spark.checkpoint.dir`` is unset and the master is one local JVM.
LOCAL_SHARED = os.path.join(tempfile.gettempdir(), "anchorage-shared")


def get_spark(cpus: int | str = "*", app: str = "anchorage") -> SparkSession:
    """Local session used by tests and the bench (a cluster passes its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the folder that ``spark.checkpoint.dir`` names.

    The setting is required: intermediate tables must be seen by every
    executor.  Only a single local JVM (``local`` / ``local[n]``), where all
    tasks share one disk, may leave it unset; any other master raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(
                "spark.checkpoint.dir must name a folder that the driver and all executors share "
                f"(master is {master!r})")
        root = LOCAL_SHARED
    return "/".join([root.rstrip("/"), *parts, uuid.uuid4().hex])


def materialize(df: DataFrame, *parts: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage: later stages read files that outlive any executor.
    """
    path = shared_dir(df.sparkSession, *parts)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def hand_small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session's actions hand Python at most ``rows`` rows at once: Arrow buffers of whole texts stay small on both sides.

    For jobs whose frames are written later, by their caller.
    """
    spark.conf.set(_BATCH_ROWS, str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """``hand_small_batches`` for the actions within it."""
    before = spark.conf.get(_BATCH_ROWS)
    hand_small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)
