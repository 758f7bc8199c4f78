"""Placing rows, and checking placements, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyspan.functions.keyspace import KeyRange, biased, id_column, in_range, parse_bound_column, required, route_column
from keyspan.plans.catalog import ShardCatalog


def place(df: DataFrame, key: str, kind: str, shards: ShardCatalog, position: str = "keyspace_id", shard: str = "shard") -> DataFrame:
    """df with each row's position and shard; a null key is an error. One codegen stage, no shuffle."""
    at = required(id_column(kind, F.col(key)), f"a row has no {key} to place it by")
    return df.withColumn(position, at).withColumn(shard, route_column(F.col(position), shards.shards))


def shard_counts(df: DataFrame, key: str, kind: str, shards: ShardCatalog) -> DataFrame:
    """(shard, n): rows of each shard that has any."""
    return df.select(route_column(id_column(kind, F.col(key)), shards.shards).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def keep_range(df: DataFrame, key: str, kind: str, r: KeyRange) -> DataFrame:
    """The rows whose key is in a range: the filter that copies and change streams share."""
    return df.filter(in_range(required(id_column(kind, F.col(key)), f"a row has no {key} to place it by"), r))


def split_evenly(df: DataFrame, parts: str) -> DataFrame:
    """df with `part` (0, 1, ...) and `bound` (start of that part of the whole space, decimal) for each number of parts.

    i * 2^64 / parts is worked out in two steps, for the product may exceed 38 digits' exactness in division.
    """
    space = F.lit("18446744073709551616").cast("decimal(38,0)")
    n = F.col(parts).cast("decimal(20,0)")
    rows = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    return rows.withColumn("bound", _quotient(F.col("part").cast("decimal(10,0)"), space, n))


def _quotient(i: Column, space: Column, n: Column) -> Column:
    """floor(i * space / n) by the quotient and remainder of space / n."""
    whole = F.floor(space / n)
    whole = F.when(whole * n > space, whole - 1).otherwise(whole).cast("decimal(20,0)")
    rest = (space - whole * n).cast("decimal(20,0)")
    return (i * whole + F.floor(i * rest / n)).cast("decimal(20,0)")


def partition_faults(ranges: DataFrame, within: list[str]) -> DataFrame:
    """(*within, name, fault): what is wrong with sets of ranges (name, start, end as bounds) as partitions.

    Faults are `not-from-zero`, `gap`, `overlap` and `not-to-end`; a sound partition has no rows. end null or empty is
    the end of the space. Groups are small: one row for each range of a partition.
    """
    lo = biased(parse_bound_column(F.coalesce("start", F.lit(""))))
    open_end = F.coalesce("end", F.lit("")) == ""
    hi = F.when(~open_end, biased(parse_bound_column(F.col("end"))))
    by = W.partitionBy(*within).orderBy("lo", "name")
    rows = ranges.withColumns({"lo": lo, "hi": hi, "open": open_end})
    rows = rows.withColumns({"before": F.lag("hi").over(by), "before_open": F.lag("open").over(by), "first": F.row_number().over(by) == 1, "last": F.lead("lo").over(by).isNull()})
    faults = F.array(
        F.when(F.col("first") & (F.col("lo") != -(1 << 63)), "not-from-zero"),
        F.when(~F.col("first") & ~F.col("before_open") & (F.col("before") < F.col("lo")), "gap"),
        F.when(~F.col("first") & (F.col("before_open") | (F.col("before") > F.col("lo"))), "overlap"),
        F.when(F.col("last") & ~F.col("open"), "not-to-end"),
    )
    return rows.select(*within, "name", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def overlaps(one: DataFrame, two: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of ranges (name, start, end) of two small tables that share a position, for equal values of `on`."""
    last = F.lit((1 << 63) - 1)
    bounds = lambda df, x: df.select(*on, F.col("name").alias(f"{x}_name"), biased(parse_bound_column(F.coalesce("start", F.lit("")))).alias(f"{x}_lo"), F.when(F.coalesce("end", F.lit("")) == "", last).otherwise(biased(parse_bound_column(F.col("end"))) - 1).alias(f"{x}_hi"))
    joined = bounds(one, "a").join(bounds(two, "b"), on)
    return joined.filter("a_lo <= b_hi and b_lo <= a_hi").select(*on, "a_name", "b_name")

