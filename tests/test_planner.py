import pytest

from keyspan.plans import planner as P
from keyspan.plans import scatter, sql
from keyspan.plans.catalog import GLOBAL, ShardCatalog, TableDef, TableName
from keyspan.plans.extract import Param, where_values
from keyspan.plans.sequences import omitted, rewrite_insert, row_count

SCHEMA = {
    TableName("public", "orders"): TableDef("customer_id", "int", sequences=(("id", "orders_id"),)),
    TableName("public", "line_items"): TableDef("customer_id", "int", sequences=(("id", "orders_id"),)),
    TableName("public", "notes"): TableDef("k", "text"),
    TableName("public", "settings"): GLOBAL,
}
SHARDS = ShardCatalog.even(4)
PLANNER = P.Planner(SCHEMA, SHARDS)
ALL = ("-40", "40-80", "80-c0", "c0-")


def route(text):
    return PLANNER.plan_all(sql.parse(text))[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("SELECT * FROM orders WHERE customer_id = 42", P.SingleShard("80-c0")),
        ("SELECT * FROM orders WHERE 42 = orders.customer_id AND note = 'x'", P.SingleShard("80-c0")),
        ("SELECT * FROM orders WHERE customer_id = '42'", P.SingleShard("80-c0")),
        ("SELECT * FROM public.orders o WHERE (o.customer_id) = (42)", P.SingleShard("80-c0")),
        ("SELECT * FROM orders WHERE customer_id IN (0, 42)", P.Scatter(("-40", "80-c0"))),
        ("SELECT * FROM orders WHERE customer_id = 0 AND customer_id = 42", P.Scatter(("-40", "80-c0"))),
        ("SELECT * FROM orders WHERE customer_id = 1 OR customer_id = 2", P.Scatter(ALL)),
        ("SELECT * FROM orders WHERE NOT customer_id = 1", P.Scatter(ALL)),
        ("SELECT * FROM orders WHERE customer_id IN (1, f())", P.Scatter(ALL)),
        ("SELECT * FROM orders WHERE customer_id = NULL", P.Scatter(ALL)),
        ("SELECT * FROM orders WHERE customer_id = 1::bigint", P.Scatter(ALL)),
        ("SELECT * FROM orders WHERE customer_id = 'abc'", P.Scatter(ALL)),
        ("SELECT * FROM orders WHERE customer_id BETWEEN 1 AND 2", P.Scatter(ALL)),
        ("SELECT * FROM orders WHERE customer_id IN (1, $1)", P.Scatter(ALL)),
        ("SELECT count(*) FROM orders", P.Scatter(ALL)),
        ("SELECT * FROM notes WHERE k = 'hello'", P.SingleShard("-40")),
        ("SELECT * FROM notes WHERE k = 1", P.Scatter(ALL)),
        ("SELECT 1", P.RouterLocal()),
        ("SELECT a IS DISTINCT FROM b FROM settings", P.Unsharded()),
        ("SELECT (SELECT count(*) FROM orders)", P.Unsharded()),
        ("SELECT * FROM generate_series(1, 2)", P.Unsharded()),
        ("SELECT * FROM settings JOIN settings s USING (id)", P.Unsharded()),
        ("SELECT * FROM pg_catalog.pg_class", P.Unsharded()),
        ("SELECT 1 UNION SELECT 2", P.RouterLocal()),
        ("SELECT a FROM settings UNION ALL (SELECT b FROM settings) ORDER BY 1", P.Unsharded()),
        ("INSERT INTO orders (customer_id, note) VALUES (42, 'a'), (42, 'b')", P.SingleShard("80-c0")),
        ("INSERT INTO orders (customer_id) VALUES (42) ON CONFLICT (customer_id) DO NOTHING", P.SingleShard("80-c0")),
        ("INSERT INTO settings VALUES (1)", P.Unsharded()),
        ("UPDATE orders SET note = 'x' WHERE customer_id = 42", P.SingleShard("80-c0")),
        ("UPDATE settings SET a = 1", P.Unsharded()),
        ("DELETE FROM ONLY orders o WHERE o.customer_id = 42 RETURNING *", P.SingleShard("80-c0")),
        ("CREATE TABLE t (a int)", P.Broadcast(ALL)),
        ("SELECT * INTO t FROM orders", P.Broadcast(ALL)),
        ("VACUUM", P.Broadcast(ALL)),
        ("BEGIN", P.RouterLocal()),
        ("SET x = 1", P.RouterLocal()),
        ("SHOW x", P.RouterLocal()),
        ("EXECUTE p(1)", P.RouterLocal()),
        ("", P.RouterLocal()),
    ],
)
def test_routes(text, expected):
    assert route(text) == expected


@pytest.mark.parametrize(
    "text,code",
    [
        ("SELECT * FROM nope", "42P01"),
        ("SELECT * FROM settings WHERE a IN (SELECT b FROM nope)", "42P01"),
        ("WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", "42P01"),
        ("SELECT * FROM pg_class", "42P01"),
        ("SELECT * FROM orders, line_items", "0A000"),
        ("SELECT * FROM orders JOIN settings s ON true", "0A000"),
        ("SELECT * FROM orders, LATERAL (SELECT 1) x", "0A000"),
        ("WITH orders AS (SELECT 1) SELECT * FROM orders", "0A000"),
        ("SELECT (SELECT 1) FROM orders", "0A000"),
        ("SELECT * FROM orders WHERE customer_id = 1 AND EXISTS (SELECT 1)", "0A000"),
        ("SELECT * FROM orders UNION SELECT 1", "0A000"),
        ("SELECT (SELECT 1) UNION SELECT 2", "0A000"),
        ("WITH x AS (SELECT 1) SELECT * FROM x UNION SELECT 2", "0A000"),
        ("SELECT * FROM generate_series(1, 2) UNION SELECT 2", "0A000"),
        ("INSERT INTO settings SELECT (SELECT 1)", "0A000"),
        ("WITH x AS (SELECT 1) INSERT INTO settings VALUES (1)", "0A000"),
        ("INSERT INTO nope VALUES (1)", "0A000"),
        ("INSERT INTO orders (customer_id) VALUES (1) ON CONFLICT (customer_id) DO UPDATE SET note = 'x'", "0A000"),
        ("INSERT INTO orders (customer_id) VALUES (1) ON CONFLICT DO NOTHING", "0A000"),
        ("INSERT INTO orders (customer_id) VALUES (1) ON CONFLICT (id) DO NOTHING", "0A000"),
        ("INSERT INTO orders (customer_id) VALUES (1) ON CONFLICT ON CONSTRAINT c DO NOTHING", "0A000"),
        ("INSERT INTO orders VALUES (1)", "0A000"),
        ("INSERT INTO orders (note) VALUES ('x')", "0A000"),
        ("INSERT INTO orders (customer_id) VALUES (DEFAULT)", "0A000"),
        ("INSERT INTO orders (customer_id) SELECT 1", "0A000"),
        ("INSERT INTO orders (customer_id) VALUES (0), (42)", "0A000"),
        ("INSERT INTO orders (customer_id) VALUES (0), ($1)", "0A000"),
        ("INSERT INTO orders (customer_id) VALUES ('x')", "0A000"),
        ("UPDATE orders SET customer_id = 2 WHERE customer_id = 1", "0A000"),
        ("UPDATE orders SET (note, customer_id) = ('a', 2) WHERE customer_id = 1", "0A000"),
        ("UPDATE orders SET note = s.a FROM settings s WHERE customer_id = 1", "0A000"),
        ("UPDATE orders SET note = (SELECT 1) WHERE customer_id = 1", "0A000"),
        ("WITH d AS (DELETE FROM settings) UPDATE orders SET note = 'x' WHERE customer_id = 1", "0A000"),
        ("UPDATE orders SET note = 'x'", "0A000"),
        ("UPDATE nope SET a = 1", "0A000"),
        ("DELETE FROM orders", "0A000"),
        ("DELETE FROM orders USING settings WHERE customer_id = 1", "0A000"),
        ("DELETE FROM orders WHERE customer_id IN (0, 42)", "0A000"),
        ("MERGE INTO orders USING settings ON true WHEN MATCHED THEN DELETE", "0A000"),
        ("COPY orders FROM STDIN", "0A000"),
        ("WITH w AS (DELETE FROM orders RETURNING *) SELECT * FROM w", "0A000"),
        ("EXPLAIN SELECT 1", "0A000"),
    ],
)
def test_refusals(text, code):
    got = route(text)
    assert isinstance(got, P.Reject) and got.code == code


def test_ctes_are_in_sight_where_they_should_be():
    assert route("WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b") == P.Unsharded()
    assert route("WITH RECURSIVE a AS (SELECT 1 UNION SELECT * FROM a) SELECT * FROM settings JOIN a ON true") == P.Unsharded()


def test_parameters():
    read = route("SELECT * FROM orders WHERE customer_id IN ($1, $2)")
    assert read == P.Parameterized("xxhash64_v1", "int", (1, 2), write=False)
    assert P.resolve_bound(read, [0, "42"], SHARDS) == P.Scatter(("-40", "80-c0"))
    assert P.resolve_bound(read, ["42", 42], SHARDS) == P.SingleShard("80-c0")
    assert P.resolve_bound(read, [1], SHARDS).code == "0A000"
    assert P.resolve_bound(read, [1, "x"], SHARDS).code == "0A000"
    write = route("UPDATE orders SET note = $2 WHERE customer_id = $1 AND customer_id = $3")
    assert write.write and isinstance(P.resolve_bound(write, [0, "n", 42], SHARDS), P.Reject)


@pytest.mark.parametrize("text", ["SELECT (", "SELEC 1", "SELECT * FROM orders WHERE )", "'abc", "SELECT 1 /* x"])
def test_syntax_errors(text):
    with pytest.raises(sql.SqlError) as error:
        sql.parse(text)
    assert error.value.code == "42601"


@pytest.mark.parametrize(
    "text,kind",
    [
        ("START TRANSACTION", sql.TXN_BEGIN), ("END", sql.TXN_COMMIT), ("ABORT", sql.TXN_ROLLBACK), ("SAVEPOINT a", sql.TXN_OTHER), ("ROLLBACK TO a", sql.TXN_OTHER), ("PREPARE TRANSACTION 'x'", sql.TXN_OTHER), ("COMMIT PREPARED 'x'", sql.TXN_OTHER),
        ("PREPARE p AS SELECT 1", sql.PREPARE_EXEC), ("DEALLOCATE p", sql.PREPARE_EXEC), ("TRUNCATE a", sql.DDL), ("GRANT a TO b", sql.DDL), ("CREATE DATABASE a", sql.OTHER), ("ALTER SYSTEM SET a = 1", sql.OTHER), ("VALUES (1)", sql.SELECT), ("TABLE settings", sql.SELECT), ("LOCK TABLE a", sql.OTHER), ("SET CONSTRAINTS ALL DEFERRED", sql.OTHER), ("RESET x", sql.SET), (";", sql.EMPTY),
    ],
)
def test_kinds(text, kind):
    assert sql.parse(text).kinds == [kind]


def test_fingerprint_and_normal_form():
    one, two = sql.parse("SELECT * FROM t WHERE a = 1 AND b IN (1, 2)"), sql.parse("select *  from t where a = 99 and b in (3,4,5)")
    assert one.fingerprint == two.fingerprint != sql.parse("SELECT * FROM t WHERE a > 1").fingerprint
    assert sql.normalize("SELECT 'a', 2 FROM t") == "SELECT $1, $2 FROM t"
    assert [t.name for t in sql.parse("SELECT * FROM a JOIN s.b ON (SELECT 1 FROM c) > 0").tables] == ["a", "b", "c"]


def test_where_values():
    tokens = sql.nested(list(sql.flat_tokens("k = 1 AND (k IN (2, '3') AND 4 = t.k) AND a BETWEEN 5 AND 6 AND k = $7")))
    assert where_values(tokens, "k") == [1, 2, "3", 4, Param(7)]


@pytest.mark.parametrize(
    "text,kind",
    [
        ("SELECT * FROM orders", scatter.CONCAT), ("SELECT id, o.note AS n FROM orders o WHERE note = 'x'", scatter.CONCAT), ("SELECT id, note FROM orders ORDER BY note DESC, 1 ASC NULLS LAST", scatter.ORDERED),
        *[(t, scatter.UNSUPPORTED_SHAPE) for t in ("SELECT * FROM orders LIMIT 1", "SELECT * FROM orders OFFSET 1", "SELECT count(*) FROM orders", "SELECT DISTINCT id FROM orders", "SELECT id FROM orders GROUP BY id", "SELECT id FROM orders HAVING true", "SELECT id + 1 FROM orders", "SELECT id FROM orders ORDER BY id + 1", "SELECT id FROM orders ORDER BY o.id", "SELECT id FROM orders ORDER BY id USING <", "WITH x AS (SELECT 1) SELECT id FROM orders", "SELECT id FROM orders FOR UPDATE", "SELECT id FROM orders UNION SELECT 1", "UPDATE orders SET a = 1", "SELECT 1", "SELECT id INTO x FROM orders")],
    ],
)
def test_scatter_shapes(text, kind):
    assert scatter.classify(text).kind == kind


def test_sort_keys():
    keys = scatter.classify("SELECT a, b FROM t ORDER BY a, b DESC, 1 NULLS FIRST").keys
    assert keys == (scatter.SortKey("a", False, False), scatter.SortKey("b", True, True), scatter.SortKey(1, False, True))


def test_sequences():
    text = "INSERT INTO orders (customer_id, note) VALUES (1, 'a)b'), (1, (2)) RETURNING id"
    tree = sql.parse(text).trees[0]
    assert omitted(tree, SCHEMA) == [("id", "orders_id")] and row_count(tree) == 2
    assert rewrite_insert(text, {"id": [7, 8]}) == "INSERT INTO orders (customer_id, note, id) VALUES (1, 'a)b', 7), (1, (2), 8) RETURNING id"
    with pytest.raises(sql.SqlError):
        rewrite_insert(text, {"id": [7]})
    assert not omitted(sql.parse("INSERT INTO orders (id, customer_id) VALUES (1, 1)").trees[0], SCHEMA)
