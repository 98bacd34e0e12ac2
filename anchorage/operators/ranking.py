"""Consecutive ranks in a global order without a single-task window.

Rows are range-partitioned once and written with their partition number,
so counts and rows come from the same partitioning.  Each partition's row
count gives its offset; ``row_number`` runs inside a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.session import materialize

_PART, _BEFORE = "__part", "__before"


def with_rank(df: DataFrame, order: list[str], by: list[str] | None = None, out: str = "rank",
              partitions: int | None = None, ascending: bool = True) -> DataFrame:
    """``df`` plus ``out``: 1, 2, ... in ``order`` within each ``by`` group.

    ``by`` columns must not be null (null keys compare as unequal in the
    offset join); ``order`` columns may be, nulls first.  Rows equal in
    ``by`` and ``order`` get different ranks in any order.  The offsets table
    has one row per range partition and group that it holds, so a group of
    any size is spread over as many tasks as it fills partitions.
    """
    by = by or []
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys: list[Column] = [F.col(c) for c in by]
    sort = [F.col(c).asc_nulls_first() if ascending else F.col(c).desc_nulls_last() for c in order]
    dealt = materialize(
        df.repartitionByRange(n, *[c.asc() for c in keys], *sort)
        .withColumn(_PART, F.spark_partition_id()), "rank")
    counts = dealt.groupBy(*by, _PART).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, _PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_BEFORE))
    within = Window.partitionBy(*by, _PART).orderBy(*sort)
    # a merge join at every size: it deals the rows as the window needs them, so they move once
    return (dealt.join(offsets.hint("merge"), [*by, _PART])
            .withColumn(out, (F.col(_BEFORE) + F.row_number().over(within)).cast("bigint"))
            .select(*df.columns, out))
