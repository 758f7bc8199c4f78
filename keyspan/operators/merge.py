"""Results of several shards as one: schema agreement, concatenation, ordered merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.plans.planner import UNSUPPORTED
from keyspan.plans.scatter import SortKey, resolve_keys
from keyspan.plans.sql import SqlError


def same_schema(one: T.StructType, two: T.StructType) -> bool:
    """Names and types in order; nullability is no part of a result's shape."""
    return [(f.name, f.dataType) for f in one] == [(f.name, f.dataType) for f in two]


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, in no order; parts must agree."""
    for p in parts[1:]:
        if not same_schema(parts[0].schema, p.schema):
            raise SqlError(UNSUPPORTED, f"shards disagree on the result: {parts[0].schema.simpleString()} and {p.schema.simpleString()}")
    return reduce(DataFrame.unionAll, parts)


def order(column: Column, key: SortKey) -> Column:
    """The database's order: numbers by value, NaN above all and equal to itself, -0.0 equal to 0.0, nulls where the key says."""
    if key.descending:
        return column.desc_nulls_first() if key.nulls_first else column.desc_nulls_last()
    return column.asc_nulls_first() if key.nulls_first else column.asc_nulls_last()


def ordered(df: DataFrame, keys: Sequence[SortKey], ties: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """df in the order of keys, a range-partitioned sort. ties: columns that order equal rows.

    strict takes only types whose order is the same everywhere; otherwise text goes by its bytes.
    """
    if strict:
        at = [df.columns[i] for i in resolve_keys(df.schema, keys)]
    else:
        at = [df.columns[k.column - 1] if isinstance(k.column, int) else k.column for k in keys]
    return df.orderBy(*[order(F.col(c), k) for c, k in zip(at, keys, strict=True)], *ties)


def merge(parts: Sequence[tuple[str, DataFrame]], keys: Sequence[SortKey], arrival: str | None = None) -> DataFrame:
    """Parts, in the order of their shards, as one ordered result; equal rows keep shard order, then arrival order.

    arrival: a column that numbers a part's rows, dropped from the result. Without one, equal rows of a shard are in any order.
    """
    tagged = concat([p.withColumn("__shard", F.lit(i)) for i, (_, p) in enumerate(parts)])
    hidden = ["__shard", *([arrival] if arrival else [])]
    resolve_keys(T.StructType([f for f in tagged.schema if f.name not in hidden]), keys)
    return ordered(tagged, keys, hidden).drop(*hidden)
