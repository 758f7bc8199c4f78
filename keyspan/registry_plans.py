"""Registered queries of planning: routes and refusals of logged statements, scatter shapes, sequences, writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan import oracle
from keyspan.engine import NATIVE, STRICT, Engine
from keyspan.operators.running import running_sum
from keyspan.operators.sequences import Allocator
from keyspan.plans import log
from keyspan.plans.catalog import TableDef, TableName
from keyspan.plans.sql import SqlError
from keyspan.registering import SCHEMA, SHARDS, registered, table
from keyspan.sources import copytext
from keyspan.sources.scratch import kept, scratch
from keyspan.sources.store import Fenced, Store, Unreachable

# Statements about a customer {k} and another {k2}: (text, kind, route, code, shards, tables). Where shards is k it is
# that of {k}; read and write are of both, a write being refused if they are two; all is every shard.
READS = [
    ("SELECT * FROM orders WHERE o_custkey = {k}", "Select", "single", "", "k", "orders"),
    ("SELECT * FROM public.orders o WHERE {k} = o.o_custkey AND (o_orderstatus = 'F' AND o_totalprice > 5)", "Select", "single", "", "k", "orders"),
    ("SELECT * FROM orders WHERE o_custkey = ' {k} '", "Select", "single", "", "k", "orders"),
    ("SELECT * FROM orders WHERE o_custkey IN ({k}, {k2})", "Select", "", "", "read", "orders"),
    ("SELECT * FROM orders WHERE o_custkey = {k} AND o_custkey = {k2}", "Select", "", "", "read", "orders"),
    ("SELECT * FROM orders WHERE o_custkey = {k} OR o_orderkey = 1", "Select", "scatter", "", "all", "orders"),
    ("SELECT * FROM orders WHERE NOT o_custkey = {k}", "Select", "scatter", "", "all", "orders"),
    ("SELECT * FROM orders WHERE o_custkey IN ({k}, abs({k2}))", "Select", "scatter", "", "all", "orders"),
    ("SELECT count(*) FROM orders", "Select", "scatter", "", "all", "orders"),
    ("SELECT * FROM orders WHERE o_custkey IN ({k}, $1)", "Select", "scatter", "", "all", "orders"),
    ("SELECT * FROM orders WHERE o_custkey = 'x{k}'", "Select", "scatter", "", "all", "orders"),
    ("SELECT * FROM orders WHERE o_custkey = NULL", "Select", "scatter", "", "all", "orders"),
    ("SELECT * FROM orders WHERE o_custkey = $1", "Select", "parameterized", "", "", "orders"),
    ("SELECT n_name FROM nation WHERE n_nationkey = {k}", "Select", "unsharded", "", "", "nation"),
    ("SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = {k}", "Select", "unsharded", "", "", "nation,region"),
    ("SELECT {k}", "Select", "local", "", "", ""),
    ("SELECT (SELECT {k})", "Select", "unsharded", "", "", ""),
    ("WITH x AS (SELECT {k} AS a) SELECT a FROM x", "Select", "unsharded", "", "", ""),
    ("SELECT * FROM pg_catalog.pg_class WHERE oid = {k}", "Select", "unsharded", "", "", "pg_catalog.pg_class"),
    ("SELECT * FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = {k}", "Select", "reject", "0A000", "", "orders,customer"),
    ("SELECT * FROM orders, nation WHERE o_custkey = {k}", "Select", "reject", "0A000", "", "orders,nation"),
    ("WITH x AS (SELECT 1) SELECT * FROM orders WHERE o_custkey = {k}", "Select", "reject", "0A000", "", "orders"),
    ("SELECT * FROM orders WHERE o_custkey = {k} AND EXISTS (SELECT 1)", "Select", "reject", "0A000", "", "orders"),
    ("SELECT * FROM missing WHERE a = {k}", "Select", "reject", "42P01", "", "missing"),
    ("WITH a AS (SELECT * FROM b), b AS (SELECT {k}) SELECT * FROM a", "Select", "reject", "42P01", "", "b"),
    ("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT a FROM missing WHERE b = {k})", "Select", "reject", "42P01", "", "nation,missing"),
    ("SELECT n_name FROM nation WHERE n_nationkey = {k} UNION SELECT r_name FROM region", "Select", "unsharded", "", "", "nation,region"),
    ("SELECT {k} UNION SELECT {k2}", "Select", "local", "", "", ""),
    ("SELECT o_custkey FROM orders WHERE o_custkey = {k} UNION SELECT c_custkey FROM customer", "Select", "reject", "0A000", "", "orders,customer"),
    ("SELECT (SELECT {k}) UNION SELECT 2", "Select", "reject", "0A000", "", ""),
    ("SELECT * FROM generate_series(1, {k}) UNION SELECT 2", "Select", "reject", "0A000", "", ""),
    ("SELECT * FROM", "", "error", "42601", "", ""),
]
WRITES = [
    ("INSERT INTO orders (o_orderkey, o_custkey) VALUES (1, {k}), (2, {k})", "Insert", "single", "", "k", "orders"),
    ("INSERT INTO orders (o_orderkey, o_custkey) VALUES (1, {k}), (2, {k2})", "Insert", "", "", "write", "orders"),
    ("INSERT INTO orders (o_orderkey, o_custkey) VALUES (1, $1)", "Insert", "parameterized", "", "", "orders"),
    ("INSERT INTO orders (o_orderkey, o_custkey) VALUES (1, {k}), (2, $1)", "Insert", "reject", "0A000", "", "orders"),
    ("INSERT INTO orders (o_orderkey) VALUES ({k})", "Insert", "reject", "0A000", "", "orders"),
    ("INSERT INTO orders VALUES (1, {k})", "Insert", "reject", "0A000", "", "orders"),
    ("INSERT INTO orders (o_custkey) VALUES (DEFAULT)", "Insert", "reject", "0A000", "", "orders"),
    ("INSERT INTO orders (o_orderkey, o_custkey) SELECT 1, {k}", "Insert", "reject", "0A000", "", "orders"),
    ("INSERT INTO orders (o_custkey) VALUES ({k}) ON CONFLICT (o_custkey) DO NOTHING", "Insert", "single", "", "k", "orders"),
    ("INSERT INTO orders (o_custkey) VALUES ({k}) ON CONFLICT DO NOTHING", "Insert", "reject", "0A000", "", "orders"),
    ("INSERT INTO orders (o_custkey) VALUES ({k}) ON CONFLICT (o_orderkey) DO NOTHING", "Insert", "reject", "0A000", "", "orders"),
    ("INSERT INTO orders (o_custkey) VALUES ({k}) ON CONFLICT (o_custkey) DO UPDATE SET o_orderkey = 1", "Insert", "reject", "0A000", "", "orders"),
    ("INSERT INTO nation (n_nationkey) VALUES ({k})", "Insert", "unsharded", "", "", "nation"),
    ("WITH x AS (SELECT 1) INSERT INTO nation (n_nationkey) VALUES ({k})", "Insert", "reject", "0A000", "", "nation"),
    ("INSERT INTO missing (a) VALUES ({k})", "Insert", "reject", "0A000", "", "missing"),
    ("UPDATE orders SET o_orderstatus = 'F' WHERE o_custkey = {k}", "Update", "single", "", "k", "orders"),
    ("UPDATE orders SET o_orderstatus = 'F' WHERE o_custkey IN ({k}, {k2})", "Update", "", "", "write", "orders"),
    ("UPDATE orders SET o_orderstatus = 'F' WHERE o_custkey = $1", "Update", "parameterized", "", "", "orders"),
    ("UPDATE orders SET o_orderstatus = 'F' WHERE o_custkey IN ({k}, $1)", "Update", "reject", "0A000", "", "orders"),
    ("UPDATE orders SET o_orderstatus = 'F' WHERE o_custkey = 'x{k}'", "Update", "reject", "0A000", "", "orders"),
    ("UPDATE orders SET o_orderstatus = 'F'", "Update", "reject", "0A000", "", "orders"),
    ("UPDATE orders SET o_custkey = {k2} WHERE o_custkey = {k}", "Update", "reject", "0A000", "", "orders"),
    ("UPDATE orders SET o_orderstatus = n_name FROM nation WHERE o_custkey = {k}", "Update", "reject", "0A000", "", "orders,nation"),
    ("UPDATE orders SET o_orderstatus = (SELECT 'F') WHERE o_custkey = {k}", "Update", "reject", "0A000", "", "orders"),
    ("UPDATE nation SET n_name = 'x' WHERE n_nationkey = {k}", "Update", "unsharded", "", "", "nation"),
    ("WITH x AS (SELECT 1) UPDATE nation SET n_name = 'x'", "Update", "unsharded", "", "", "nation"),
    ("UPDATE missing SET a = {k}", "Update", "reject", "0A000", "", "missing"),
    ("DELETE FROM orders WHERE o_custkey = {k}", "Delete", "single", "", "k", "orders"),
    ("DELETE FROM orders WHERE o_custkey IN ({k}, {k2})", "Delete", "", "", "write", "orders"),
    ("DELETE FROM orders USING nation WHERE o_custkey = {k}", "Delete", "reject", "0A000", "", "orders,nation"),
    ("WITH x AS (SELECT 1) DELETE FROM orders WHERE o_custkey = {k}", "Delete", "reject", "0A000", "", "orders"),
    ("DELETE FROM orders", "Delete", "reject", "0A000", "", "orders"),
    ("DELETE FROM missing WHERE a = {k}", "Delete", "reject", "0A000", "", "missing"),
]
OTHERS = [
    ("CREATE TABLE t{k} (a int)", "Ddl", "broadcast", "", "all", ""),
    ("MERGE INTO nation USING region ON true WHEN MATCHED THEN DELETE", "Merge", "reject", "0A000", "", ""),
    ("COPY orders FROM STDIN", "Copy", "reject", "0A000", "", ""),
    ("WITH x AS (DELETE FROM orders WHERE o_custkey = {k} RETURNING *) SELECT * FROM x", "Other", "reject", "0A000", "", "orders"),
    ("SET x = {k}", "Set", "local", "", "", ""),
    ("SHOW x", "Show", "local", "", "", ""),
    ("BEGIN", "TxnBegin", "local", "", "", ""),
    ("COMMIT", "TxnCommit", "local", "", "", ""),
    ("ROLLBACK", "TxnRollback", "local", "", "", ""),
    ("SAVEPOINT s", "TxnOther", "local", "", "", ""),
    ("EXECUTE p({k})", "PrepareExec", "local", "", "", ""),
    ("", "Empty", "local", "", "", ""),
    ("SELECT {k}; SELECT {k2}", "Select,Select", "reject", "0A000", "", ""),
    ("EXPLAIN SELECT {k}", "Other", "reject", "0A000", "", ""),
]
_WRITING = ("Insert", "Update", "Delete", "Merge", "Ddl", "Copy", "Other")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def statements(spark, sf_dir: str, texts: list[str]) -> DataFrame:
    """(id, t, text): a statement about each customer, of the kinds in turn."""
    k = F.col("c_custkey")
    t = k % len(texts)
    text = F.element_at(F.array(*[F.lit(x) for x in texts]), (t + 1).cast("int"))
    filled = F.replace(F.replace(text, F.lit("{k}"), k.cast("string")), F.lit("{k2}"), (k * 7 + 1).cast("string"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), t.alias("t"), filled.alias("text"))


def _routes_sql(cases: list) -> str:
    full = lambda names: ",".join(n if "." in n else f"public.{n}" for n in names.split(",")) if names else ""
    rows = ", ".join(f"({i}, {', '.join(_quoted(x) for x in (kind, route, code, hit, full(names)))}, {str(any(k in _WRITING for k in kind.split(','))).lower()}, {str(kind.startswith('Txn')).lower()})" for i, (_, kind, route, code, hit, names) in enumerate(cases))
    every = ",".join(SHARDS.all())
    return oracle.positions("SELECT c_custkey AS k FROM customer UNION SELECT c_custkey * 7 + 1 FROM customer") + (
        f", cases(t, kind, route, code, hit, tables, writes, txn) AS (VALUES {rows}), homes AS (SELECT k, {oracle.shard_case(SHARDS)} AS shard FROM placed) "
        "SELECT c_custkey AS id, nullif(kind, '') AS kind, CASE WHEN hit = 'read' THEN CASE WHEN a.shard = b.shard THEN 'single' ELSE 'scatter' END WHEN hit = 'write' THEN CASE WHEN a.shard = b.shard THEN 'single' ELSE 'reject' END ELSE route END AS route, "
        f"CASE WHEN hit = 'all' THEN '{every}' WHEN hit = 'k' OR hit IN ('read', 'write') AND a.shard = b.shard THEN a.shard WHEN hit = 'read' THEN least(a.shard, b.shard) || ',' || greatest(a.shard, b.shard) ELSE '' END AS shards, "
        "CASE WHEN hit = 'write' AND a.shard <> b.shard THEN '0A000' ELSE code END AS code, tables, writes, txn AS \"transaction\" "
        f"FROM customer JOIN cases ON t = c_custkey % {len(cases)} JOIN homes a ON a.k = c_custkey JOIN homes b ON b.k = c_custkey * 7 + 1"
    )


def _routed(spark, sf_dir, cases):
    rows = statements(spark, sf_dir, [c[0] for c in cases]).select("id", "text", F.lit(None).cast("array<string>").alias("args"))
    return log.route_log(rows, SCHEMA, SHARDS).drop("fingerprint")


@registered(_routes_sql(READS))
def plan_reads(spark, sf_dir):
    """Every shape of a read: one shard, several, all, global, local, deferred, refused."""
    return _routed(spark, sf_dir, READS)


@registered(_routes_sql(WRITES))
def plan_writes(spark, sf_dir):
    return _routed(spark, sf_dir, WRITES)


@registered(_routes_sql(OTHERS))
def plan_others(spark, sf_dir):
    return _routed(spark, sf_dir, OTHERS)


_BOUND = [
    ("SELECT * FROM orders WHERE o_custkey IN ($1, $2)", "k k2", "read"), ("SELECT * FROM orders WHERE o_custkey = $2", "k k2", "k2"), ("SELECT * FROM orders WHERE o_custkey = $2", "k", "no"),
    ("SELECT * FROM orders WHERE o_custkey = $1", "x", "no"), ("UPDATE orders SET o_orderstatus = 'F' WHERE o_custkey = $1", "k", "k"), ("DELETE FROM orders WHERE o_custkey IN ($1, $2)", "k k2", "write"),
]


@registered(
    oracle.positions("SELECT c_custkey AS k FROM customer UNION SELECT c_custkey * 7 + 1 FROM customer")
    + f", cases(t, hit) AS (VALUES {', '.join(f'({i}, {_quoted(c[2])})' for i, c in enumerate(_BOUND))}), homes AS (SELECT k, {oracle.shard_case(SHARDS)} AS shard FROM placed) "
    "SELECT c_custkey AS id, CASE WHEN hit = 'no' OR hit = 'write' AND a.shard <> b.shard THEN 'reject' WHEN hit = 'read' AND a.shard <> b.shard THEN 'scatter' ELSE 'single' END AS route, "
    "CASE WHEN hit = 'no' OR hit = 'write' AND a.shard <> b.shard THEN '' WHEN hit = 'k2' THEN b.shard WHEN hit = 'k' OR a.shard = b.shard THEN a.shard ELSE least(a.shard, b.shard) || ',' || greatest(a.shard, b.shard) END AS shards "
    f"FROM customer JOIN cases ON t = c_custkey % {len(_BOUND)} JOIN homes a ON a.k = c_custkey JOIN homes b ON b.k = c_custkey * 7 + 1"
)
def plan_bound(spark, sf_dir):
    """Plans that wait for parameters, completed with values, as numbers and as text."""
    rows = statements(spark, sf_dir, [c[0] for c in _BOUND])
    values = {"k": F.col("id").cast("string"), "k2": (F.col("id") * 7 + 1).cast("string"), "x": F.lit("1.5")}
    args = F.element_at(F.array(*[F.array(*[values[v] for v in c[1].split()]) for c in _BOUND]), (F.col("t") + 1).cast("int"))
    return log.route_log(rows.withColumn("args", args), SCHEMA, SHARDS).select("id", "route", "shards")


@registered(f"SELECT c_custkey % {len(READS)} AS t, count(*) AS statements, CASE WHEN t = {len(READS) - 1} THEN 0 ELSE 1 END AS fingerprints FROM customer GROUP BY 1")
def statement_fingerprints(spark, sf_dir):
    """Statements that differ in literals only have one fingerprint."""
    rows = statements(spark, sf_dir, [c[0] for c in READS])
    prints = log.route_log(rows.withColumn("args", F.lit(None).cast("array<string>")), SCHEMA, SHARDS).select("id", "fingerprint")
    return rows.join(prints, "id").groupBy("t").agg(F.count(F.lit(1)).alias("statements"), F.count_distinct("fingerprint").cast("int").alias("fingerprints"))


_LITERALS = [
    ("SELECT * FROM orders WHERE o_custkey = {k} AND o_orderstatus = 'it''s'", "SELECT * FROM orders WHERE o_custkey = $1 AND o_orderstatus = $2"), ("SELECT $1, {k}, 1.5e3 /* 7 */", "SELECT $1, $2, $3 /* 7 */"),
    ("SELECT \"a1\", t1.b FROM t1 -- {k}", None), ("INSERT INTO t (a) VALUES ({k}), ($x$it's {k2}$x$)", "INSERT INTO t (a) VALUES ($1), ($2)"),
]


@registered(f"WITH cases(t, text) AS (VALUES {', '.join(f'({i}, {_quoted(c[1] or c[0])})' for i, c in enumerate(_LITERALS))}) SELECT c_custkey AS id, replace(text, '{{k}}', CAST(c_custkey AS VARCHAR)) AS text FROM customer JOIN cases ON t = c_custkey % {len(_LITERALS)}")
def normalized_statements(spark, sf_dir):
    return log.normalized_log(statements(spark, sf_dir, [c[0] for c in _LITERALS]))


_LIST = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders"
_SHAPES = [
    (_LIST, "concat", "", "", ""), (f"{_LIST} WHERE o_custkey > {{k}}", "concat", "", "", ""), (f"{_LIST} ORDER BY o_custkey", "ordered", "o_custkey asc last", "1", ""), (f"{_LIST} ORDER BY 3 DESC, o_orderkey", "ordered", "3 desc first,o_orderkey asc last", "2,0", ""),
    (f"{_LIST} ORDER BY o_totalprice DESC NULLS LAST, 2 NULLS FIRST", "ordered", "o_totalprice desc last,2 asc first", "2,1", ""), (f"{_LIST} ORDER BY o_orderstatus", "ordered", "o_orderstatus asc last", "", "0A000"), (f"{_LIST} ORDER BY 9", "ordered", "9 asc last", "", "0A000"),
    (f"{_LIST} ORDER BY nowhere", "ordered", "nowhere asc last", "", "0A000"), (f"{_LIST} ORDER BY orders.o_custkey", "unsupported", "", "", ""), (f"{_LIST} ORDER BY o_custkey + 1", "unsupported", "", "", ""), (f"{_LIST} LIMIT {{k}}", "unsupported", "", "", ""),
    (f"{_LIST} OFFSET 1", "unsupported", "", "", ""), ("SELECT DISTINCT o_custkey FROM orders", "unsupported", "", "", ""), ("SELECT count(*) FROM orders", "unsupported", "", "", ""), ("SELECT o_custkey FROM orders GROUP BY o_custkey", "unsupported", "", "", ""),
    ("SELECT o_custkey + {k} FROM orders", "unsupported", "", "", ""), (f"{_LIST} FOR UPDATE", "unsupported", "", "", ""), ("SELECT * FROM orders", "concat", "", "", ""), ("SELECT o_custkey AS c, orders.o_orderkey FROM orders", "concat", "", "", ""), ("SELECT NULL FROM orders", "unsupported", "", "", ""),
]


@registered(f"WITH cases(t, shape, keys, positions, code) AS (VALUES {', '.join(f'({i}, {", ".join(_quoted(x) for x in c[1:])})' for i, c in enumerate(_SHAPES))}) SELECT c_custkey AS id, shape, keys, positions, code FROM customer JOIN cases ON t = c_custkey % {len(_SHAPES)}")
def scatter_shapes(spark, sf_dir):
    """Whether results of several shards can become one, and by which columns they are merged."""
    rows = statements(spark, sf_dir, [c[0] for c in _SHAPES])
    schema = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").schema
    return log.scatter_log(rows, schema)


# --- sequences ------------------------------------------------------------------------------------------------------

_WITH_IDS = {**SCHEMA, TableName("public", "orders"): TableDef("o_custkey", "int", sequences=(("o_orderkey", "orders_id"),))}


@registered(
    "WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS t, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n FROM customer), "
    "f AS (SELECT *, 1000 + sum(n) OVER (ORDER BY k) - n AS i FROM c) SELECT k AS id, CASE t WHEN 0 THEN 'INSERT INTO orders (o_custkey, o_orderkey) VALUES (' || k || ', ' || CAST(i AS BIGINT) || ')' "
    "WHEN 1 THEN 'INSERT INTO orders (o_custkey, o_orderstatus, o_orderkey) VALUES (' || k || ', ''a)'', ' || CAST(i AS BIGINT) || '), (' || k || ', ''b'', ' || CAST(i + 1 AS BIGINT) || ')' "
    "ELSE 'INSERT INTO orders (o_custkey, o_orderkey) VALUES (' || k || ', 5)' END AS text FROM f"
)
def seq_rewrite(spark, sf_dir):
    """INSERTs that leave a sequence-bound column out, with ids from one reserved block, dense in the statements' order."""
    texts = ["INSERT INTO orders (o_custkey) VALUES ({k})", "INSERT INTO orders (o_custkey, o_orderstatus) VALUES ({k}, 'a)'), ({k}, 'b')", "INSERT INTO orders (o_custkey, o_orderkey) VALUES ({k}, 5)"]
    needed = kept(log.ids_needed(statements(spark, sf_dir, texts), _WITH_IDS), "needed")  # dealt into ranges it is read twice
    store = Store(spark, scratch(spark, "sequences"))
    store.create_sequence("orders_id", 1000, start=1000)
    first, _ = store.reserve("orders_id", max(1, needed.agg(F.sum("rows")).first()[0] or 0))
    numbered = running_sum(needed, [], ["id"], F.col("rows").cast("long"), "upto")
    return log.with_ids(numbered.withColumn("first", F.lit(first) + F.col("upto") - F.col("rows")))


@registered("SELECT n_nationkey, 1000 + row_number() OVER (ORDER BY n_nationkey) - 1 AS id, 10 - (row_number() OVER (ORDER BY n_nationkey) - 1) % 10 - 1 <= 2 AS refill FROM nation")
def seq_blocks(spark, sf_dir):
    """Ids drawn one by one: blocks of ten, a new one once a block is used up, and told when a fifth is left."""
    store = Store(spark, scratch(spark, "sequences"))
    store.create_sequence("s", 10, start=1000)
    ids = Allocator(store.reserve)
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # one row a nation
    return spark.createDataFrame([(k, ids.next_id("s"), ids.needs_refill("s")) for k in keys], "n_nationkey int, id long, refill boolean")


# --- writes ---------------------------------------------------------------------------------------------------------

_ROW = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"


def _stored(spark, sf_dir) -> Engine:
    """An engine over a store that holds orders, sharded, and nation."""
    store = Store(spark, scratch(spark, "writes"))
    rows = table(spark, sf_dir, "orders").selectExpr(*_ROW.split(", "))
    store.create("public.orders", rows.schema, _WITH_IDS[TableName("public", "orders")])
    store.append("public.orders", rows, SHARDS)
    store.create("public.nation", table(spark, sf_dir, "nation").schema)
    store.append("public.nation", table(spark, sf_dir, "nation"), SHARDS)
    store.create_sequence("orders_id", 100, start=-500)
    return Engine(spark, _WITH_IDS, SHARDS, store)


@registered(f"SELECT {_ROW} FROM orders UNION ALL SELECT * FROM (VALUES (-500, 42, 'N', 'new'), (-499, 42, 'N', NULL))")
def write_insert(spark, sf_dir):
    """An INSERT into a stored table, of a single shard, with ids drawn from the table's sequence."""
    e = _stored(spark, sf_dir)
    e.sql("INSERT INTO orders (o_custkey, o_orderstatus, o_orderpriority) VALUES (42, 'N', 'new'), (42, 'N', NULL)", STRICT)
    return e.table("orders")


@registered("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey = 42 AND o_orderkey > 100 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey = 42 AND o_orderkey > 100 THEN o_orderpriority || '!' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def write_update(spark, sf_dir):
    """An UPDATE that rewrites the one shard that its key is in."""
    e = _stored(spark, sf_dir)
    e.sql("UPDATE orders SET o_orderstatus = 'Z', o_orderpriority = o_orderpriority || '!' WHERE o_custkey = 42 AND o_orderkey > 100", STRICT)
    return e.table("orders")


@registered(f"SELECT {_ROW} FROM orders WHERE NOT (o_custkey = 42) AND o_orderstatus <> 'P'")
def write_delete(spark, sf_dir):
    """A keyed DELETE in one shard, then one over all of them, which only the native mode does."""
    e = _stored(spark, sf_dir)
    e.sql("DELETE FROM orders WHERE o_custkey = 42", STRICT)
    e.sql("DELETE FROM orders WHERE o_orderstatus = 'P'", NATIVE)
    return e.table("orders")


@registered(f"SELECT {_ROW} FROM orders WHERE o_custkey IN (42, 7)")
def write_returning(spark, sf_dir):
    e = _stored(spark, sf_dir)
    one, two = (e.sql(f"DELETE FROM orders WHERE o_custkey = {k} RETURNING *", STRICT) for k in (42, 7))
    return one.unionByName(two)


@registered(f"SELECT {_ROW} FROM orders WHERE o_custkey IN (42, 7) AND o_orderstatus = 'F'")
def read_stored_keys(spark, sf_dir):
    """A routed read of a stored table: only the folders of the shards that the keys hash to are opened."""
    return _stored(spark, sf_dir).sql(f"SELECT {_ROW} FROM orders WHERE o_custkey IN (42, 7) AND o_orderstatus = 'F'", STRICT)


@registered("SELECT * FROM (VALUES ('fenced shard', '25006'), ('fenced by another', 'conflict'), ('after the fence', ''), ('lease run out', '57P01'), ('no ids', '55000'), ('files gone', '08006'), ('transaction', '0A000'), ('two statements', '0A000'), ('broadcast', '0A000'), ('scattered count', '0A000'), ('no table', '42P01'), ('no syntax', '42601')) v(what, code)")
def sqlstates(spark, sf_dir):
    """The SQLSTATE of each refusal, from an engine over a store."""
    e = _stored(spark, sf_dir)
    insert = "INSERT INTO orders (o_orderkey, o_custkey) VALUES (-1, 42)"

    def code(run) -> str:
        try:
            run()
        except (SqlError, Fenced, Unreachable) as error:
            return error.code
        except Exception as error:
            return type(error).__name__.lower()
        return ""

    def other(schema=_WITH_IDS, **options) -> Engine:
        return Engine(spark, schema, SHARDS, **options)

    shard = e.explain_route(insert)[0].shard
    e.store.fence(shard, "a")
    out = [("fenced shard", code(lambda: e.sql(insert, STRICT))), ("fenced by another", code(lambda: e.store.fence(shard, "b")))]
    assert not e.store.unfence(shard, "b") and e.store.unfence(shard, "a")
    out.append(("after the fence", code(lambda: e.sql(insert, STRICT))))
    out.append(("lease run out", code(lambda: other(store=e.store, may_write=lambda: False).sql(insert, STRICT))))
    unsequenced = Store(spark, scratch(spark, "writes"))
    unsequenced.create("public.orders", e.store.schema("public.orders"), _WITH_IDS[TableName("public", "orders")])
    out.append(("no ids", code(lambda: other(store=unsequenced).sql("INSERT INTO orders (o_custkey) VALUES (42)", STRICT))))
    gone = Store(spark, scratch(spark, "writes"))
    gone.create("public.nation", table(spark, sf_dir, "nation").schema)
    gone.commit(gone.manifest(), lambda m: m["tables"]["public.nation"]["shards"].update({"global": ["lost"]}))
    out.append(("files gone", code(lambda: other(store=gone).sql("SELECT * FROM nation", STRICT))))
    for what, text in (("transaction", "BEGIN"), ("two statements", "SELECT 1; SELECT 2"), ("broadcast", "CREATE TABLE t (a int)"), ("scattered count", "SELECT count(*) FROM orders"), ("no table", "SELECT * FROM missing"), ("no syntax", "SELECT * FROM")):
        out.append((what, code(lambda text=text: e.sql(text, STRICT))))
    return spark.createDataFrame(out, T._parse_datatype_string("what string, code string"))


_TAGGED = [("INSERT 0 7", "INSERT 0"), ("SELECT 5", "SELECT"), ("SHOW", ""), ("UPDATE x", ""), ("DELETE 12", "DELETE"), ("CREATE TABLE", "")]


@registered(
    f"WITH t(t, prefix) AS (VALUES {', '.join(f'({i}, {_quoted(p)})' for i, (_, p) in enumerate(_TAGGED))}) SELECT c_custkey AS id, nullif(prefix, '') AS prefix, "
    f"CASE WHEN c_custkey % {len(WRITES)} < 15 THEN 'INSERT 0' WHEN c_custkey % {len(WRITES)} < 27 THEN 'UPDATE' ELSE 'DELETE' END AS returning FROM customer JOIN t ON t = c_custkey % {len(_TAGGED)}"
)
def command_tags(spark, sf_dir):
    """Command tags without their counts, and the tags of writes that return rows."""
    tag = F.element_at(F.array(*[F.lit(t) for t, _ in _TAGGED]), (F.col("id") % len(_TAGGED) + 1).cast("int"))
    routed = _routed(spark, sf_dir, WRITES)
    return routed.select("id", copytext.counted_tag(tag).alias("prefix"), copytext.returning_tag(F.col("kind")).alias("returning"))
