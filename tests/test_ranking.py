import pytest
from pyspark.sql import functions as F

from anchorage.operators.ranking import with_rank
from anchorage.session import shared_dir


def test_ranks_are_consecutive_in_every_group(spark):
    df = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        (F.col("id") * 7919 % 50_021).alias("v"), F.repeat(F.lit("x"), 50).alias("payload"))
    got = with_rank(df, ["v"], by=["k"], out="r", partitions=13).cache()
    assert got.count() == 50_000
    assert got.columns == ["k", "v", "payload", "r"]
    bad = got.groupBy("k").agg(F.count("r").alias("n"), F.countDistinct("r").alias("d"), F.max("r").alias("m"))
    assert bad.where("n <> d or n <> m").count() == 0
    rows = got.orderBy("k", "r").select("k", "v").collect()
    assert rows == sorted(rows)


def test_ranks_with_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "v int")
    assert sorted((r.v or 0, r["rank"]) for r in with_rank(df, ["v"]).collect()) == [(0, 1), (1, 2), (1, 3), (2, 4)]
    assert with_rank(df.limit(0), ["v"]).collect() == []


def test_shared_dir_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
