"""What registered queries share: the tables, how they are sharded, and the registry itself.

Sharded tables: orders by o_custkey, customer by c_custkey, lineitem by l_orderkey, events by user_id; the others are global.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyspan.engine import Engine
from keyspan.plans.catalog import GLOBAL, ShardCatalog, TableDef, TableName

SHARDS = ShardCatalog.even(4)
KEYS = {"orders": "o_custkey", "customer": "c_custkey", "lineitem": "l_orderkey", "events": "user_id"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SCHEMA = {TableName("public", t): TableDef(KEYS[t], "int") if t in KEYS else GLOBAL for t in TABLES}

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    out = Engine(spark, SCHEMA, SHARDS)
    for t in TABLES:
        out.attach(t, table(spark, sf_dir, t))
    return out


def registered(sql: str | None = None):
    """Registers a query (spark, sf_dir) under its name, and the SQL that it is held against."""

    def add(f):
        assert f.__name__ not in QUERIES, f.__name__
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
