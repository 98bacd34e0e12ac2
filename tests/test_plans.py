"""Plan shape: the entries pipeline shuffles once; stream = batch."""

import os
import re

import pytest

from anchorage.operators.entries import explode_entries
from anchorage.plans.catalog import QUERIES, page_entries, wrapped_entries
from anchorage.streaming.jobs import stream_extract

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange(spark):
    spark.catalog.clearCache()  # other modules cache these frames
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # snapshots: exactly the one row-number exchange of the entries builder
        plan = _plan(wrapped_entries(spark, SF))
        assert re.findall(r"Exchange (\w+)\(([a-z_]+)", plan) == [("hashpartitioning", "_row")]
        # HTML pages: raw HTML is never shuffled, only the link arrays are
        plan = _plan(page_entries(spark, SF))
        assert re.findall(r"Exchange (\w+)\(([a-z_]+)", plan) == [("hashpartitioning", "_row")]
        # page columns and own links need no exchange at all
        for query in ("page_meta", "resolved_links", "redirect_params"):
            assert "Exchange" not in _plan(QUERIES[query](spark, SF))
        for p in (plan, _plan(wrapped_entries(spark, SF))):
            assert "NestedLoop" not in p and "Cartesian" not in p and "Python" not in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stream_equals_batch(spark):
    streamed = stream_extract(spark, SF, "pages.parquet")
    batch = explode_entries(page_entries(spark, SF)).drop("page_url", "title")
    cols = sorted(batch.columns)
    assert sorted(streamed.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def test_streams_take_tables_that_are_folders_of_files(spark, tmp_path):
    from anchorage.streaming.jobs import stream_refresh

    sf, n = tmp_path.as_uri(), {}
    for table in ("pages", "events"):
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        rows.repartition(3).write.parquet(f"{sf}/{table}.parquet")
        n[table] = rows.count()
    streamed = stream_extract(spark, sf, "pages.parquet")
    cols = sorted(streamed.columns)
    batch = explode_entries(page_entries(spark, SF)).select(*cols)
    assert sorted(streamed.select(*cols).collect()) == sorted(batch.collect())
    refreshed = stream_refresh(spark, sf, files_per_batch=2)
    assert refreshed.selectExpr("count(*)", "sum(n_requests)").first() == (n["pages"], n["events"])
