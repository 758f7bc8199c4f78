"""The engine: tables, their placement, and SQL in two modes.

`strict` does what a router of sharded databases may do: it routes, merges plain results, and refuses the rest with an
SQLSTATE. `native` runs the same statement on Spark over the union of all shards; routing then only prunes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.functions.keyspace import id_column, route_column, text_id_column
from keyspan.operators.merge import order
from keyspan.operators.sequences import Allocator, SequenceError
from keyspan.operators.temporal import Catalog, resolve
from keyspan.plans import planner as P
from keyspan.plans import scatter, sql
from keyspan.plans.catalog import ShardCatalog, TableDef, TableName, Topology, VSchema
from keyspan.plans.sequences import omitted, rewrite_insert, row_count
from keyspan.plans.sql import Query, SqlError, Token, Tokens, Write
from keyspan.sources.store import GLOBAL_SHARD, Store
from keyspan.streaming.apply import Applier

STRICT, NATIVE = "strict", "native"
LEASE_EXPIRED = "57P01"


class ReadOnly(SqlError):
    """A write while the lease has run out."""

    def __init__(self) -> None:
        super().__init__(LEASE_EXPIRED, "the topology is not confirmed any more; writes wait")


def render(tokens: Tokens) -> str:
    """Tokens as Spark SQL: quoted names in backticks, $n as :pn."""
    out = []
    for t in tokens:
        if t.kind == "name":
            out.append("`" + t.text.replace("`", "``") + "`")
        elif t.kind == "string":
            out.append("'" + t.text.replace("\\", "\\\\").replace("'", "\\'") + "'")
        elif t.kind == "param":
            out.append(f":p{t.text[1:]}")
        elif t.kind == "group":
            out.append(f"({render(t.items)})")
        elif t.kind == "index":
            out.append(f"[{render(t.items)}]")
        elif t.is_op(".", "::") and out:
            out.append(out.pop() + t.text)
        elif out and out[-1].endswith((".", "::")):
            out.append(out.pop() + t.text)
            continue
        else:
            out.append(t.text)
        if len(out) > 1 and out[-2].endswith((".", "::")):
            last = out.pop()
            out.append(out.pop() + last)
    return " ".join(out)


def _unqualified(tokens: Tokens, names: set[tuple[str, str]], views: dict[tuple[str, str], str]) -> Tokens:
    """Known tables' names, qualified or not, replaced by the names of their views."""
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind in ("group", "index"):
            out.append(Token(t.kind, "", _unqualified(t.items, names, views)))
        elif sql.is_name(t) and i + 2 < len(tokens) and tokens[i + 1].is_op(".") and (t.text, tokens[i + 2].text) in names:
            out.append(Token("name", views[t.text, tokens[i + 2].text]))
            i += 2
        else:
            out.append(t)
        i += 1
    return tuple(out)


class Engine:
    """Tables are data frames (placed by computing) or tables of a store (placed by folder)."""

    def __init__(self, spark: SparkSession, vschema: VSchema, shards: ShardCatalog, store: Store | None = None, may_write: Callable[[], bool] = lambda: True):
        self.spark, self.vschema, self.shards, self.store, self.may_write = spark, dict(vschema), shards, store, may_write
        self._frames: dict[TableName, DataFrame] = {}
        self._planner = P.Planner(self.vschema, shards)
        self._ids = Allocator(store.reserve) if store else None

    @classmethod
    def from_topology(cls, spark: SparkSession, topology: Topology, **options) -> Engine:
        topology.validate().routable()
        return cls(spark, topology.vschema(), topology.catalog(), **options)

    def attach(self, name: str, df: DataFrame) -> Engine:
        """Gives a table its rows. Its position is worked out where it is asked for."""
        self._frames[TableName.of(name)] = df
        return self

    # --- tables -----------------------------------------------------------------------------------------------------

    def definition(self, name: str) -> TableDef:
        return self.vschema[TableName.of(name)]

    def table(self, name: str | TableName, shards: Sequence[str] | None = None) -> DataFrame:
        """Rows of a table, of some shards if given: of a stored table their folders, of an attached frame those that hash there."""
        name = name if isinstance(name, TableName) else TableName.of(name)
        found = self.vschema[name]
        if name in self._frames:
            df = self._frames[name]
            if shards is None or found.key is None or len(shards) == len(self.shards.shards):
                return df
            return df.filter(self.shard_column(name).isin(list(shards)))
        return self.store.read(str(name), None if found.key is None else shards)

    def shard_column(self, name: str | TableName):
        """Column expression: the shard of a sharded table's row."""
        name = name if isinstance(name, TableName) else TableName.of(name)
        return route_column(self.placement(F.col(self.vschema[name].key), self.vschema[name].key_type), self.shards.shards)

    @staticmethod
    def placement(column, kind: str, as_text: bool = False):
        """Column expression: the keyspace position of a key, or of a key given as text."""
        return text_id_column(kind, column) if as_text else id_column(kind, column)

    # --- statements -------------------------------------------------------------------------------------------------

    def explain_route(self, statement: str, args: Sequence | None = None) -> list[P.Plan]:
        """How each statement is routed; parameters are resolved if they have values."""
        plans = self._planner.plan_all(sql.parse(statement))
        return [P.resolve_bound(p, args, self.shards) if args is not None and isinstance(p, P.Parameterized) else p for p in plans]

    def sql(self, statement: str, mode: str = NATIVE, args: Sequence = ()) -> DataFrame | None:
        """Runs one statement; a write returns None, or its RETURNING rows."""
        parsed = sql.parse(statement)
        if len(parsed.trees) != 1:
            raise SqlError(P.UNSUPPORTED, "one statement at a time")
        if P.is_transaction_control(parsed):
            raise SqlError(P.UNSUPPORTED, "there are no transactions over statements")
        if P.is_write(parsed) and not self.may_write():
            raise ReadOnly()
        kind, tree, tokens = parsed.kinds[0], parsed.trees[0], parsed.statements[0]
        plan = self._planner.plan(kind, tree)
        if isinstance(plan, P.Parameterized) and args:
            plan = P.resolve_bound(plan, args, self.shards)
        if mode == STRICT:
            if isinstance(plan, P.Reject):
                raise SqlError(plan.code, plan.reason)
            if isinstance(plan, P.Broadcast | P.Parameterized):
                raise SqlError(P.UNSUPPORTED, "not executed: " + type(plan).__name__.lower())
            if isinstance(plan, P.Scatter):
                return self._scatter(statement, tree, tokens, plan, args)
        elif isinstance(plan, P.Reject) and plan.code == P.UNDEFINED_TABLE:
            raise SqlError(plan.code, plan.reason)
        if isinstance(tree, Write):
            return self._write(statement, tree, plan, args)
        if kind != sql.SELECT:
            return self.spark.sql(statement)
        hit = (plan.shard,) if isinstance(plan, P.SingleShard) else plan.shards if isinstance(plan, P.Scatter) else None
        return self._run(tree, tokens, hit, args)

    def _run(self, tree: Query, tokens: Tokens, shards: Sequence[str] | None, args: Sequence) -> DataFrame:
        views, names = {}, set()
        for t in sql.relations(tree):
            name = P.table_name(t)
            if name in self.vschema:
                view = t.name if name.schema == "public" else f"{name.schema}__{t.name}"
                self.table(name, shards if self.vschema[name].key else None).createOrReplaceTempView(f"`{view}`")
                views[name.schema, t.name] = view
                names.add((name.schema, t.name))
        text = render(_order_explicitly(_unqualified(tokens, names, views)))
        return self.spark.sql(text, args={f"p{i + 1}": v for i, v in enumerate(args)}) if args else self.spark.sql(text)

    def _scatter(self, statement: str, tree: Query, tokens: Tokens, plan: P.Scatter, args: Sequence) -> DataFrame:
        shape = scatter.classify(statement)
        if shape.kind == scatter.UNSUPPORTED_SHAPE:
            raise SqlError(P.UNSUPPORTED, "a read of several shards is a plain projection, perhaps ordered by its columns")
        rows = self._run(tree, _without_order(tokens), plan.shards, args)
        if shape.kind == scatter.CONCAT:
            return rows
        at = scatter.resolve_keys(rows.schema, shape.keys)
        return rows.orderBy(*[order(F.col(rows.columns[i]), k) for i, k in zip(at, shape.keys, strict=True)])

    # --- writes -----------------------------------------------------------------------------------------------------

    def _write(self, statement: str, tree: Write, plan: P.Plan, args: Sequence) -> DataFrame | None:
        if self.store is None:
            raise SqlError(P.UNSUPPORTED, "no store to write to")
        name = P.table_name(tree.table)
        if name not in self.vschema:
            raise SqlError(P.UNDEFINED_TABLE, f"{name} is no table of the sharding configuration")
        if isinstance(plan, P.Reject) and tree.verb != "insert" and (tree.froms or tree.ctes):
            raise SqlError(plan.code, plan.reason)
        if self.vschema[name].key is not None and self.vschema[name].key in tree.sets:
            raise SqlError(P.UNSUPPORTED, "a shard key is never changed")
        named = {f"p{i + 1}": v for i, v in enumerate(args)}
        if tree.verb == "insert":
            rows = self._inserted(statement, tree, named)
            self.store.append(str(name), rows, self.shards)
            changed = rows
        else:
            changed = self._changed(tree, name, plan, named)
        return changed.selectExpr(*[render(t) for t in sql.split_at(tree.clauses["returning"], ",")]) if "returning" in tree.clauses else None

    def _inserted(self, statement: str, tree: Write, named: dict) -> DataFrame:
        name = P.table_name(tree.table)
        if missing := omitted(tree, self.vschema):
            if self._ids is None:
                raise SqlError(SequenceError.code, "no sequences to draw from")
            n = row_count(tree)
            try:
                ids = {c: [self._ids.next_id(s) for _ in range(n)] for c, s in missing}
            except Exception as error:
                raise SqlError(SequenceError.code, str(error)) from error
            tree = sql.parse(rewrite_insert(statement, ids)).trees[0]
        schema = self.store.schema(str(name))
        columns = tree.columns or schema.names
        if tree.query is None or tree.query.values is None:
            raise SqlError(P.UNSUPPORTED, "INSERT takes VALUES here; use Engine.insert for a data frame")
        text = "SELECT * FROM VALUES " + ", ".join(f"({render(row)})" for row in tree.query.values)
        rows = self.spark.sql(text, args=named).toDF(*columns)
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def insert(self, name: str, df: DataFrame) -> None:
        """Appends rows of any number, each to its shard."""
        if not self.may_write():
            raise ReadOnly()
        self.store.append(str(TableName.of(name)), df, self.shards)

    def _changed(self, tree: Write, name: TableName, plan: P.Plan, named: dict) -> DataFrame:
        """Copies the shards a change may touch, changed; returns the rows that it matched."""
        base = self.store.manifest()
        found = self.vschema[name]
        hit = [GLOBAL_SHARD] if found.key is None else [plan.shard] if isinstance(plan, P.SingleShard) else self.shards.all()
        rows = self.store.read(str(name), hit, version=base["version"] or None)
        alias = f"__changing_{re.sub(r'\\W', '_', name.name)}"
        rows.createOrReplaceTempView(alias)
        where = render(tree.clauses["where"]) if "where" in tree.clauses else "true"
        marked = self.spark.sql(f"SELECT *, coalesce(({where}), false) AS __hit FROM {alias} AS `{name.name}`", args=named)
        sets = {}
        for part in sql.split_at(tree.clauses["set"], ",") if tree.verb == "update" else ():
            if len(part) < 3 or not part[1].is_op("="):
                raise SqlError(P.UNSUPPORTED, "SET takes column = value here")
            sets[part[0].text] = render(part[2:])
        if unknown := [c for c in sets if c not in rows.columns]:
            raise SqlError("42703", f"{name} has no column {unknown[0]}")
        if tree.verb == "delete":
            matched, after = marked.filter("__hit").drop("__hit"), marked.filter("not __hit").drop("__hit")
        else:
            marked.createOrReplaceTempView(f"{alias}_m")
            cells = ", ".join(f"CASE WHEN __hit THEN CAST(({sets[f.name]}) AS {f.dataType.simpleString()}) ELSE `{f.name}` END AS `{f.name}`" if f.name in sets else f"`{f.name}`" for f in rows.schema)
            both = self.spark.sql(f"SELECT {cells}, __hit FROM {alias}_m AS `{name.name}`", args=named)
            matched, after = both.filter("__hit").drop("__hit"), both.drop("__hit")
        self.store.replace(str(name), hit, after, self.shards, base)
        return matched

    # --- streams and restores -----------------------------------------------------------------------------------------

    def apply(self, frames: DataFrame, consumer: str, keys: dict[str, list[str]], **options) -> dict:
        """Applies decoded or raw change frames to the store, once each."""
        return Applier(self.store, consumer, keys, self.shards).apply_frames(frames, **options)

    @staticmethod
    def resolve_restore(topologies: DataFrame, barriers: DataFrame, backups: DataFrame, **target) -> DataFrame:
        return resolve(Catalog(topologies, barriers, backups), **target)


def _clause(tokens: Tokens, first: str) -> tuple[int, int] | None:
    """(start, end) of `first BY ...` at this level."""
    for i, t in enumerate(tokens):
        if t.is_word(first) and i + 1 < len(tokens) and tokens[i + 1].is_word("by"):
            end = next((j for j in range(i + 2, len(tokens)) if tokens[j].is_word("limit", "offset", "fetch", "for")), len(tokens))
            return i, end
    return None


def _without_order(tokens: Tokens) -> Tokens:
    at = _clause(tokens, "order")
    return tokens if at is None else tokens[: at[0]] + tokens[at[1] :]


def _order_explicitly(tokens: Tokens) -> Tokens:
    """ORDER BY with the place of nulls said, for the defaults differ: last ascending, first descending."""
    at = _clause(tokens, "order")
    if at is None:
        return tokens
    items = []
    for part in sql.split_at(tokens[at[0] + 2 : at[1]], ","):
        if not any(t.is_word("nulls") for t in part):
            part = (*part, Token("word", "nulls"), Token("word", "first" if part[-1].is_word("desc") else "last"))
        items += [*part, Token("op", ",")]
    return (*tokens[: at[0] + 2], *items[:-1], *tokens[at[1] :])

