"""Sums and last values along an order, without a task that sees all rows of a group.

Rows are range-partitioned by group and order and kept as a table (a range partitioning need not come out the same
twice). Each partition's total is one row for each group in it; what comes before a partition is worked out over those
few rows, and the rest within the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyspan.sources.scratch import kept


def _dealt(df: DataFrame, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*within, *order]
    return kept(df.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()), "running")


def _along(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str, total: Column, earlier, own: Column, both) -> DataFrame:
    """total: aggregate of a partition's group; earlier(c): of totals before; own: the value up to a row; both(before, own)."""
    rows = _dealt(df, within, order)
    sums = rows.groupBy("__part", *within).agg(total.alias("__total"))
    before = sums.withColumn("__before", earlier("__total").over(W.partitionBy(*within).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))).drop("__total")
    same = rows["__part"] == before["__part"]
    for c in within:
        same &= rows[c].eqNullSafe(before[c])
    out = rows.join(F.broadcast(before), same, "left").drop(before["__part"], *[before[c] for c in within])
    upto = W.partitionBy("__part", *within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn(name, both(F.col("__before"), own.over(upto))).drop("__part", "__before")


def running_sum(df: DataFrame, within: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of its group up to each row, itself included; null counts as nothing.

    order must be unique within a group.
    """
    return _along(df, within, order, name, F.sum(value), F.sum, F.sum(value), lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0)))


def last_value(df: DataFrame, within: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """df with the last value that is not null at or before each row of its group; null if there is none. order must be unique."""
    top = F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct(*order)))
    return _along(df, within, order, name, top, lambda c: F.last(c, ignorenulls=True), F.last(value, ignorenulls=True), lambda before, own: F.coalesce(own, before))
