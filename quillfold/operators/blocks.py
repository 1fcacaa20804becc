"""Running values over one global order, without a window that puts all rows in one task.

Rows are windowed inside blocks of the order column; what a block hands on is computed from one row for each
block, and only that small table is windowed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_max(df: DataFrame, order: str, value: Column, name: str, block: int) -> DataFrame:
    """``name``: the largest value at or before each row; nulls are skipped."""
    rows = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    whole = rows.groupBy("_block").agg(F.max("_value").alias("_top"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_block", F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(whole, "_block").withColumn(name, F.greatest(F.max("_value").over(inside), "_before")).drop("_block", "_value", "_before")


def running_last(df: DataFrame, order: str, value: Column, name: str, block: int) -> DataFrame:
    """``name``: the last value at or before each row that isn't null."""
    rows = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    whole = rows.groupBy("_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_block", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(whole, "_block").withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), "_before")).drop("_block", "_value", "_before")


def next_above(df: DataFrame, key: str, points: DataFrame, point: str, carried: str, name: str, block: int) -> DataFrame:
    """``name``: of the points above ``key``, the least one's ``carried`` (both longs); null if there is none."""
    where = lambda c: F.floor(F.col(c) / block)
    marks = points.groupBy(F.col(point).alias("_point")).agg(F.min(carried).alias("_carried"))
    pair = F.struct("_point", "_carried")
    whole = marks.groupBy(where("_point").alias("_b")).agg(F.min(pair).alias("_first"))
    # A block without points needs the next one that has some, so rows' blocks take part as well.
    used = df.select(where(key).alias("_b")).distinct().join(whole, "_b", "full").select("_b", "_first")
    after = Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    used = used.select("_b", F.first("_first", ignorenulls=True).over(after).alias("_later"))
    marked = marks.select(where("_point").alias("_b"), F.col("_point").alias("_at"), pair.alias("_mark"))
    rows = df.withColumn("_b", where(key)).withColumn("_at", F.col(key))
    both = rows.unionByName(marked, allowMissingColumns=True)
    # Of equal places rows come after points, so a point at the key itself isn't above it.
    up = Window.partitionBy("_b").orderBy("_at", F.col("_mark").isNull().cast("int")).rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("_near", F.first("_mark", ignorenulls=True).over(up)).where(F.col("_mark").isNull())
    out = found.join(used, "_b", "left").withColumn(name, F.coalesce(F.col("_near"), F.col("_later"))["_carried"])
    return out.drop("_b", "_at", "_mark", "_near", "_later")
