"""Planning as an operator over logs of statements: a row for each, in Arrow batches, on any number of executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keyspan.plans import planner as P
from keyspan.plans import scatter, sql
from keyspan.plans.catalog import ShardCatalog, VSchema
from keyspan.plans.sequences import insert_rows, omitted, rewrite_insert, row_count
from keyspan.plans.sql import SqlError

#: What a statement's route is called.
ROUTES = {P.SingleShard: "single", P.Scatter: "scatter", P.Broadcast: "broadcast", P.Unsharded: "unsharded", P.RouterLocal: "local", P.Parameterized: "parameterized", P.Reject: "reject"}


def _by_row(df: DataFrame, schema: str, of: Callable[[dict], dict]) -> DataFrame:
    """of each row, worked out by all cores: a log is read in as many tasks as its files have row groups, which may be one."""
    spark = df.sparkSession
    df = df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([of(row) for row in batch.to_pylist()], schema=arrow)

    return df.mapInArrow(run, kind)


def route_log(statements: DataFrame, vschema: VSchema, shards: ShardCatalog) -> DataFrame:
    """How each statement (id, text, args array<string>) is read and routed; null args leave parameters open.

    Text that can't be read has the route `error`. Several statements in one text are refused as a whole.
    """
    planner = P.Planner(vschema, shards)

    def planned(parsed: sql.Parsed | SqlError) -> tuple[dict, P.Plan | None]:
        out = {"kind": None, "route": "error", "shards": "", "code": "", "tables": "", "writes": False, "transaction": False, "fingerprint": None}
        if isinstance(parsed, SqlError):
            return out | {"code": parsed.code}, None
        out |= {"kind": ",".join(parsed.kinds), "tables": ",".join(str(P.table_name(t)) for t in parsed.tables), "writes": P.is_write(parsed), "transaction": P.is_transaction_control(parsed), "fingerprint": parsed.fingerprint}
        if len(parsed.trees) != 1:
            return out | {"route": "reject", "code": P.UNSUPPORTED}, None
        return out, planner.plan(parsed.kinds[0], parsed.trees[0])

    shapes = sql.Shapes(planned)

    def of(row: dict) -> dict:
        out, plan = shapes(row["text"] or "")
        out = {"id": row["id"], **out}
        if plan is None:
            return out
        if isinstance(plan, P.Parameterized) and row["args"] is not None:
            plan = P.resolve_bound(plan, row["args"], shards)
        hit = (plan.shard,) if isinstance(plan, P.SingleShard) else getattr(plan, "shards", ())
        return out | {"route": ROUTES[type(plan)], "shards": ",".join(hit), "code": getattr(plan, "code", "")}

    return _by_row(statements.select("id", "text", "args"), "id long, kind string, route string, shards string, code string, tables string, writes boolean, transaction boolean, fingerprint string", of)


def normalized_log(statements: DataFrame) -> DataFrame:
    """(id, text) with literals replaced by numbered parameters."""
    return _by_row(statements.select("id", "text"), "id long, text string", lambda row: {"id": row["id"], "text": sql.normalize(row["text"] or "")})


def scatter_log(statements: DataFrame, result: T.StructType) -> DataFrame:
    """(id, shape, keys, positions, code): how results of several shards of each statement (id, text) would become one.

    result: the columns that the statements give. keys are name or position, direction and place of nulls.
    """

    def merged(parsed: sql.Parsed | SqlError) -> dict:
        shape = scatter.shape_of(parsed)
        keys = ",".join(f"{k.column} {'desc' if k.descending else 'asc'} {'first' if k.nulls_first else 'last'}" for k in shape.keys)
        try:
            at = scatter.resolve_keys(result, shape.keys)
        except SqlError as error:
            return {"shape": shape.kind, "keys": keys, "positions": "", "code": error.code}
        return {"shape": shape.kind, "keys": keys, "positions": ",".join(map(str, at)), "code": ""}

    shapes = sql.Shapes(merged)
    return _by_row(statements.select("id", "text"), "id long, shape string, keys string, positions string, code string", lambda row: {"id": row["id"], **shapes(row["text"] or "")})


def ids_needed(statements: DataFrame, vschema: VSchema) -> DataFrame:
    """(id, text, columns, rows): the sequence-bound columns that each INSERT leaves out, and the ids that each of them takes."""

    def missing(parsed: sql.Parsed | SqlError) -> dict:
        if isinstance(parsed, SqlError):
            raise parsed
        found = omitted(parsed.trees[0], vschema)
        return {"columns": [c for c, _ in found], "rows": row_count(parsed.trees[0]) if found else 0}

    shapes = sql.Shapes(missing)
    return _by_row(statements.select("id", "text"), "id long, text string, columns array<string>, rows int", lambda row: {**row, **shapes(row["text"])})


def with_ids(needed: DataFrame) -> DataFrame:
    """(id, text): INSERTs (id, text, columns, rows, first) with ids from `first` on for every column that they leave out."""

    rows_of = sql.Shapes(insert_rows)

    def of(row: dict) -> dict:
        ids = {c: list(range(row["first"], row["first"] + row["rows"])) for c in row["columns"]}
        return {"id": row["id"], "text": rewrite_insert(row["text"], ids, rows_of) if ids else row["text"]}

    return _by_row(needed.select("id", "text", "columns", "rows", "first"), "id long, text string", of)
