"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of the component of every node of ``edges(a, b)``.

    Alternates two steps until the edges stay the same: each node hands its least
    neighbour to its larger ones, then to its smaller ones (large star, small star).
    The number of rounds grows with the logarithm of the longest path.  The least
    neighbour is summed up before the shuffle and joined back, so a node that a third
    of all edges meet is no single task.  Every round is written and read again.
    """
    at = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "llm", "edges")
    before = None
    while True:
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # every larger neighbour b of a, and the least node around a
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        at = materialize(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                         .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "llm", "edges")
        seen = at.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == seen:
            return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = seen
