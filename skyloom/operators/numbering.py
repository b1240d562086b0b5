"""Dense numbers of rows in an order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.plans.scratch import Scratch


def _by_ranges(df: DataFrame, order: list[str | Column], amount: Column, name: str) -> DataFrame:
    """Adds the sum of amount over the rows up to and with this one, in the given order.

    Rows are dealt by ranges of the order and written with their range's number; each range is added up
    by itself and shifted by the sums of the ranges before it. Only one sum for each range meets in one place.
    """
    part = "_range"
    dealt = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    dealt = Scratch(df.sparkSession).keep(dealt, "dealt")
    sums = dealt.groupBy(part).agg(F.sum(amount).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.sum(amount).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn(name, own).join(F.broadcast(starts), part).withColumn(name, (F.col("_first") + F.col(name)).cast("long")).drop(part, "_first")


def running_sum(df: DataFrame, order: list[str | Column], amount: str, name: str) -> DataFrame:
    """Adds the whole-number sum of a column over the rows up to and with this one, in the given order."""
    return _by_ranges(df, order, F.col(amount), name)


def dense_index(df: DataFrame, order: list[str | Column], name: str = "index") -> DataFrame:
    """Adds a long column 0.. in the given order; rows that tie in it are numbered in any order."""
    return _by_ranges(df, order, F.lit(1), name).withColumn(name, F.col(name) - 1)
