"""Distributed running totals over a hash-random or evenly spread order.

A window over a whole group puts a hot group into one task. Here each group is cut
into 65536 buckets that follow the order; totals of 256 coarse and 256 fine buckets
are summed by windows of at most 256 rows, and only the rows of one bucket meet in
one window. A bucket holds a 65536th of its group, as keys spread evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_sums(rows: DataFrame, group: str, bucket: str, value: Column) -> DataFrame:
    """One row per group and bucket: ``fine``, the sum of ``value``. Reads only what ``value`` needs; empty input gives no rows."""
    return rows.groupBy(group, bucket).agg(F.sum(value).alias("fine"))


def bucket_starts(fine: DataFrame, group: str, bucket: str) -> DataFrame:
    """One row per row of ``bucket_sums``: ``before``, the sum of earlier buckets, and ``whole``, the group's sum.

    ``fine`` is read twice; where that is dear, pass it written.
    """
    fine = fine.withColumn("coarse", F.shiftright(F.col(bucket), 8))
    coarse = fine.groupBy(group, "coarse").agg(F.sum("fine").alias("part"))
    earlier = Window.partitionBy(group).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(
        group, "coarse",
        F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("coarse_before"),
        F.sum("part").over(Window.partitionBy(group)).alias("whole"),
    )
    inside = Window.partitionBy(group, "coarse").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (
        fine.withColumn("inside", F.coalesce(F.sum("fine").over(inside), F.lit(0)))
        .join(coarse, [group, "coarse"])
        .select(group, bucket, (F.col("coarse_before") + F.col("inside")).alias("before"), "whole")
    )


def within_bucket(group: str, bucket: str, order: list, value: Column) -> Column:
    """Sum of ``value`` over the earlier rows of the same bucket."""
    w = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))
