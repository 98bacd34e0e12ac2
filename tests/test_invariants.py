"""Invariants on the driver tables (sf0.001): dedup idempotent, visible ⊆
entries, ranks dense, report counts agree with the rows."""

import os

import pytest
from pyspark.sql import functions as F

from anchorage.operators.entries import explode_entries
from anchorage.operators.order import dedup_page
from anchorage.plans.catalog import page_entries, wrapped_entries
from anchorage.plans.visible import visible_links, visible_pages
from anchorage.settings import Settings

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def ents(spark):
    return wrapped_entries(spark, SF).cache()


def test_dedup_idempotent(ents):
    once = explode_entries(dedup_page(ents))
    twice = explode_entries(dedup_page(dedup_page(ents)))
    assert sorted(once.collect()) == sorted(twice.collect())
    assert once.groupBy("page_id", "display_url").count().where("count > 1").count() == 0


def test_visible_subset_and_ranks(spark, ents):
    s = Settings(text_exclude="again")
    vis = visible_links(spark, ents, s)
    all_e = explode_entries(ents).select("page_id", "display_url", "dom_index", "variant_index")
    assert vis.select("page_id", "display_url", "dom_index", "variant_index").subtract(all_e).count() == 0
    bad = vis.groupBy("page_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m <> n")
    assert bad.count() == 0
    rep = visible_pages(spark, ents, s).select("page_id", "n_visible", "lines")
    cnt = vis.groupBy("page_id").agg(F.count("*").alias("c"))
    joined = rep.join(cnt, "page_id", "left").where("coalesce(c, 0) <> n_visible OR lines <> n_visible")
    assert joined.count() == 0


def test_wrapped_shape(ents):
    # 8 kept links + 3 surfaced targets per page; the skipped scheme leaves a gap
    per_page = explode_entries(ents).groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum(F.col("surfaced").cast("int")).alias("t"),
        F.max(F.when(F.col("dom_index") == 6, 1).otherwise(0)).alias("has6"))
    assert per_page.where("n <> 17 OR t <> 6 OR has6 <> 0").count() == 0


def test_pages_all_resolved(spark):
    ents = page_entries(spark, SF)
    rows = explode_entries(ents)
    assert rows.where("display_url IS NULL OR NOT startswith(display_url, 'http')").count() == 0
    assert ents.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
