import random

import pytest
from pyspark.sql import functions as F

from keyspan.functions import keyspace as K
from keyspan.functions.keyspace import KeyRange, KeyspaceError

VECTORS = [
    ("int", 0, "34c96acdcadb1bbb"),
    ("int", 1, "9f1ffc793b8a47da"),
    ("int", 42, "a2c396223f8bdbdf"),
    ("int", -1, "85d136adb773c6c9"),
    ("int", 9223372036854775807, "043de1bbaf341994"),
    ("text", "", "ef46db3751d8e999"),
    ("text", "hello", "26c7827d889f6da3"),
    ("text", "customer-12345", "ab540c504509fb51"),
    ("uuid", bytes(range(16)), "44b6ef2fb84169f7"),
    ("bytea", bytes.fromhex("deadbeef"), "2ff5cfb6af9aaf68"),
]


@pytest.mark.parametrize("kind,value,expected", VECTORS)
def test_golden_positions(kind, value, expected):
    assert f"{K.keyspace_id(value):016x}" == expected


def test_golden_positions_as_columns(spark):
    for kind, value, expected in VECTORS:
        sql_type = {"int": "bigint", "text": "string"}.get(kind, "binary")
        row = spark.createDataFrame([(value,)], f"k {sql_type}").select(F.lower(F.hex(K.id_column(kind, F.col("k"))))).first()
        assert row[0].rjust(16, "0") == expected


@pytest.mark.parametrize(
    "kind,value,expected",
    [
        ("int", "1", 1), ("int", 1, 1), ("int", "  -42 ", -42), ("int", "+5", 5), ("int", " 5", 5),
        ("int", "abc", None), ("int", "1.5", None), ("int", "", None), ("int", "9999999999999999999999", None), ("int", "1e3", None), ("int", True, None),
        ("text", "1", "1"), ("text", 1, None),
        ("uuid", "00010203-0405-0607-0809-0A0B0C0D0E0F", bytes(range(16))), ("uuid", "{000102030405060708090a0b0c0d0e0f}", bytes(range(16))), ("uuid", "not-a-uuid", None), ("uuid", "0001", None), ("uuid", "{000102030405060708090a0b0c0d0e0f", None),
        ("bytea", r"\xdeadbeef", bytes.fromhex("deadbeef")), ("bytea", r"\x", b""), ("bytea", "deadbeef", None), ("bytea", r"\xabc", None), ("bytea", r"\xzz", None),
    ],
)
def test_coercion(spark, kind, value, expected):
    assert K.coerce(kind, value) == expected
    if isinstance(value, str):
        got = spark.createDataFrame([(value,)], "k string").select(K.coerce_column(kind, F.col("k"))).first()[0]
        assert (bytes(got) if isinstance(got, bytearray) else got) == expected


def test_bounds_round_trip(spark):
    rng = random.Random(7)
    values = [0, 1, 1 << 63, (1 << 64) - 1, 0x4000000000000000, *(rng.getrandbits(64) for _ in range(50))]
    for v in values:
        assert K.parse_bound(K.format_bound(v)) == v
    df = spark.createDataFrame([(K.signed(v),) for v in values], "p long")
    rows = df.select("p", K.format_bound_column(F.col("p")).alias("t")).withColumn("back", K.parse_bound_column(F.col("t"))).collect()
    assert [r["t"] for r in rows] == [K.format_bound(v) for v in values]
    assert all(r["p"] == r["back"] for r in rows)
    with pytest.raises(KeyspaceError):
        K.canonical_bound("4000")


def test_ranges():
    rng = random.Random(3)
    for _ in range(200):
        a, b = sorted((rng.getrandbits(64), rng.getrandbits(64)))
        r = KeyRange(a, b)
        assert KeyRange.parse(str(r)) == r
        parts = r.split_evenly(rng.randint(1, 64))
        assert parts[0].start == a and parts[-1].stop == b and all(x.stop == y.start for x, y in zip(parts, parts[1:], strict=False))
    parts = KeyRange().split_evenly(7)
    K.validate_partition(parts)
    assert all(sum(p in r for r in parts) == 1 for p in (rng.getrandbits(64) for _ in range(100)))
    for bad in ([], parts[1:], parts[:-1], [parts[0], *parts[2:]], [*parts, parts[3]]):
        with pytest.raises(KeyspaceError):
            K.validate_partition(bad)
    with pytest.raises(KeyspaceError):
        KeyRange(5, 5)


def test_routing_columns_agree_with_python(spark):
    from keyspan.plans.catalog import ShardCatalog

    catalog = ShardCatalog.even(5)
    df = spark.range(-300, 300).withColumn("p", K.id_column("int", F.col("id"))).withColumn("s", K.route_column(F.col("p"), catalog.shards))
    r = catalog.shards[3][1]
    for row in df.withColumn("in", K.in_range(F.col("p"), r)).collect():
        position = K.keyspace_id(row["id"])
        assert row["p"] == K.signed(position) and row["s"] == catalog.route(position) and row["in"] == (position in r)


def test_a_null_key_is_never_placed(spark):
    df = spark.createDataFrame([(None,)], "k long")
    assert df.select(K.id_column("int", F.col("k"))).first()[0] is None
    with pytest.raises(Exception, match="no key"):
        df.select(K.required(K.id_column("int", F.col("k")), "no key")).collect()


def test_codegen_without_python(spark):
    plan = spark.range(10).select(K.route_column(K.id_column("int", F.col("id")), [("a", KeyRange(0, 1 << 63)), ("b", KeyRange(1 << 63))]))._jdf.queryExecution().toString()
    assert "*(1) Project" in plan and "Python" not in plan
