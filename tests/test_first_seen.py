"""D2 across runs: the kept index against one run over everything."""

import pytest

from anchorage.operators.first_seen import add_first_seen, compact_first_seen, first_seen
from anchorage.operators.order import dedup_corpus
from anchorage.session import shared_dir

SCHEMA = "display_url string, page_id bigint, pos bigint, text string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_runs_equal_one_run(spark):
    rows = [(f"u{(p * 7 + k * k) % 23}" if (p + k) % 11 else None, p, k, f"{p}/{k}") for p in range(12) for k in range(9)]
    one = _rows(dedup_corpus(spark.createDataFrame(rows, SCHEMA)).select("display_url", "page_id", "pos", "text"))
    path = shared_dir(spark, "first_seen_test")
    parts = [[r for r in rows if r[1] % 3 == n] for n in (2, 0, 1)]
    for run, part in enumerate(parts):
        written = add_first_seen(spark.createDataFrame(part, SCHEMA), path, run)
        # tried again: the same rows, nothing is seen twice
        first = _rows(written)
        assert _rows(add_first_seen(spark.createDataFrame(part, SCHEMA), path, run)) == first
    assert _rows(first_seen(spark, path).select("display_url", "page_id", "pos", "text")) == one
    small = shared_dir(spark, "first_seen_test")
    compact_first_seen(spark, path, small)
    assert _rows(first_seen(spark, small).select("display_url", "page_id", "pos", "text")) == one
    assert add_first_seen(spark.createDataFrame(rows, SCHEMA), small, 1).count() == 0


def test_only_new_or_earlier_rows_are_written(spark):
    path = shared_dir(spark, "first_seen_test")
    add_first_seen(spark.createDataFrame([("a", 5, 1, "a5"), ("b", 5, 2, "b5"), (None, 5, 3, "n5")], SCHEMA), path, 0)
    again = [("a", 4, 9, "a4"), ("b", 5, 2, "other"), ("b", 6, 0, "b6"), (None, 7, 0, "n7"), ("c", 9, 9, None)]
    assert _rows(add_first_seen(spark.createDataFrame(again, SCHEMA), path, 1)) == _rows(
        spark.createDataFrame([("a", 4, 9, "a4"), ("c", 9, 9, None)], SCHEMA).select("display_url", "page_id", "pos", "text"))
    assert {r.display_url: r.text for r in first_seen(spark, path).collect()} == {"a": "a4", "b": "b5", None: "n5", "c": None}


def test_empty_run_and_number(spark):
    path = shared_dir(spark, "first_seen_test")
    none = spark.createDataFrame([], SCHEMA)
    assert add_first_seen(none, path, 0).count() == 0
    assert first_seen(spark, path).count() == 0
    assert add_first_seen(spark.createDataFrame([("a", 1, 0, "x")], SCHEMA), path, 1).count() == 1
    assert add_first_seen(none, path, 2).count() == 0
    assert first_seen(spark, path).count() == 1
    with pytest.raises(ValueError):
        add_first_seen(none, path, -1)
