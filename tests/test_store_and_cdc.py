import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.engine import NATIVE, STRICT, Engine
from keyspan.functions.keyspace import KeyRange
from keyspan.operators.sequences import Allocator, number_rows
from keyspan.plans.catalog import GLOBAL, ShardCatalog, TableDef, TableName
from keyspan.plans.sql import SqlError
from keyspan.sources import copytext, framelog, pgoutput
from keyspan.sources.store import Conflict, Store, StoreError
from keyspan.streaming.apply import Applier, copy_range

SCHEMA = "id bigint, customer_id int, note string"
DEFS = {TableName("public", "orders"): TableDef("customer_id", "int", sequences=(("id", "orders_id"),)), TableName("public", "settings"): GLOBAL}
SHARDS = ShardCatalog.even(4)


@pytest.fixture
def engine(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create("public.orders", T._parse_datatype_string(SCHEMA), DEFS[TableName("public", "orders")])
    store.create("public.settings", T._parse_datatype_string("name string, value int"), GLOBAL)
    store.create_sequence("orders_id", 100)
    return Engine(spark, DEFS, SHARDS, store)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_write_and_read(engine):
    engine.sql("INSERT INTO orders (customer_id, note) VALUES (0, 'zero'), (0, 'null too')", STRICT)
    engine.sql("INSERT INTO orders (customer_id, note) VALUES (42, 'x''y'), (42, NULL)", STRICT)
    engine.sql("INSERT INTO settings VALUES ('a', 1)", STRICT)
    assert rows(engine.sql("SELECT id, note FROM orders WHERE customer_id = 0", STRICT)) == [(1, "zero"), (2, "null too")]
    plan = engine.sql("SELECT * FROM orders WHERE customer_id = 0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters")[1][:80]
    assert rows(engine.sql("SELECT count(*) AS n, max(s.value) AS v FROM public.orders o JOIN settings s ON true WHERE o.customer_id > $1", NATIVE, [5])) == [(2, 1)]
    with pytest.raises(SqlError) as refused:
        engine.sql("SELECT count(*) FROM orders", STRICT)
    assert refused.value.code == "0A000"
    got = [r["note"] for r in engine.sql("SELECT id, note FROM orders ORDER BY id DESC", STRICT).collect()]
    assert got == [None, "x'y", "null too", "zero"]
    assert rows(engine.sql("UPDATE orders SET note = concat(note, '!') WHERE customer_id = 0 AND id = 1 RETURNING id, note")) == [(1, "zero!")]
    engine.sql("DELETE FROM orders WHERE note IS NULL")
    assert rows(engine.sql("SELECT note FROM orders")) == [("null too",), ("x'y",), ("zero!",)]
    with pytest.raises(SqlError):
        engine.sql("UPDATE orders SET customer_id = 1 WHERE customer_id = 0")
    assert [r["n"] for r in engine.sql("SELECT note AS n FROM orders ORDER BY n LIMIT 2").collect()] == ["null too", "x'y"]


def test_an_expired_lease_blocks_writes(engine):
    engine.may_write = lambda: False
    with pytest.raises(SqlError) as refused:
        engine.sql("DELETE FROM settings", STRICT)
    assert refused.value.code == "57P01"
    assert engine.sql("SELECT 1 AS a").first()["a"] == 1


def test_one_of_two_writers_wins(engine):
    base = engine.store.manifest()
    engine.store.commit(base, lambda m: None)
    with pytest.raises(Conflict):
        engine.store.commit(base, lambda m: None)


def test_sequences_are_disjoint(spark, engine, tmp_path):
    other = Store(spark, engine.store.root)
    a, b = Allocator(engine.store.reserve), Allocator(other.reserve)
    ids = [x.next_id("orders_id") for _ in range(150) for x in (a, b)]
    assert len(set(ids)) == 300 and min(ids) == 1
    assert a.needs_refill("orders_id") is False and a.refill("orders_id") is False
    with pytest.raises(StoreError):
        engine.store.create_sequence("bad", 0)
    got = number_rows(spark.range(1000).withColumn("r", F.rand(1)), ["r"], 50, "n")
    assert sorted(r["n"] for r in got.collect()) == list(range(50, 1050))


def test_copy_text(spark, tmp_path):
    data = [(1, "tab\there", b"\x01\xff", True), (2, "back\\slash\nline\r", None, False), (3, None, b"", None), (4, "\\N", b"x", True), (5, "", None, None)]
    df = spark.createDataFrame(data, "id long, note string, raw binary, ok boolean")
    copytext.write(df, str(tmp_path / "t"))
    lines = [r["value"] for r in spark.read.option("lineSep", "\n").text(str(tmp_path / "t")).collect()]
    assert "1\ttab\\there\t\\\\x01ff\tt" in lines and "3\t\\N\t\\\\x\t\\N" in lines
    back = copytext.read(spark, str(tmp_path / "t"), df.columns).select(*[copytext.typed(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])
    key = lambda r: (r["id"], r["note"], None if r["raw"] is None else bytes(r["raw"]), r["ok"])
    assert sorted(map(key, back.collect())) == data
    assert copytext.parse_lines(spark.createDataFrame([("a\\qb\\v",)], "value string"), ["c"]).first()["c"] == "aqb\x0b"
    with pytest.raises(Exception, match="fields"):
        copytext.parse_lines(spark.createDataFrame([("a\tb",)], "value string"), ["c"]).collect()


def test_decoder():
    d = pgoutput.Decoder()
    assert d.decode(pgoutput.begin(5, 9, 1)) == {"op": "begin", "commit_lsn": 5, "xid": 9, "ts": 1}
    assert d.decode(pgoutput.relation(1, "public", "t", [("id", 23, True)]))["columns"] == [{"flags": 1, "name": "id", "type_oid": 23, "typmod": -1}]
    assert d.decode(pgoutput.update(1, [b"1", ..., None], [b"0", None, None]))["before_kind"] == "key"
    for bad in (b"I\0\0\0\1X", pgoutput.begin(1) + b"x", b"?", b"B\0", b"I\0\0\0\1N\0\1t\0\0\0\xff", b"I\0\0\0\1N\0\1q", b""):
        with pytest.raises(pgoutput.DecodeError):
            d.decode(bad)
    d.decode(b"S\0\0\0\7\1")
    assert d.in_stream and d.decode(b"I\0\0\0\7" + pgoutput.insert(1, [b"a"])[1:])["xid"] == 7
    d.decode(b"E")
    assert not d.in_stream
    assert pgoutput.Decoder(parallel=True).decode(b"A\0\0\0\1\0\0\0\2" + b"\0" * 16)["subxid"] == 2
    assert d.decode(b"b" + b"\0" * 28 + b"gid\0")["op"] == "begin_prepare"
    assert d.decode(b"M\1" + b"\0" * 8 + b"p\0\0\0\0\2hi")["content"] == b"hi"
    assert d.decode(b"T\0\0\0\1\0\0\0\0\5")["relations"] == [5]


def log(*transactions, start=100):
    """Frames of transactions, each a list of row frames; positions count up by 10."""
    out = [pgoutput.relation(1, "public", "orders", [("id", 20, True), ("customer_id", 23, True), ("note", 25, False)])]
    for i, changes in enumerate(transactions):
        lsn = start + 10 * i
        out += [pgoutput.begin(lsn), *changes, pgoutput.commit(lsn, lsn + 1)]
    return [("s0", i, bytearray(f)) for i, f in enumerate(out)]


def cells(id_, customer, note):
    return [str(id_).encode(), str(customer).encode(), note if note in (None, ...) else note.encode()]


def frames(spark, rows):
    return spark.createDataFrame(rows, "shard string, seq long, frame binary")


KEYS = {"public.orders": ["id", "customer_id"]}


def test_apply_once(spark, engine):
    apply = Applier(engine.store, "c", KEYS, SHARDS)
    first = log([pgoutput.insert(1, cells(1, 0, "a")), pgoutput.insert(1, cells(2, 42, "b"))], [pgoutput.update(1, cells(1, 0, "a2")), pgoutput.update(1, cells(2, 42, ...))], [pgoutput.delete(1, cells(2, 42, None)), pgoutput.insert(1, cells(3, 7, None))])
    assert apply.apply_frames(frames(spark, first)) == {"lsn": 120, "end_lsn": 121}
    want = [(1, 0, "a2"), (3, 7, None)]
    assert rows(engine.table("orders")) == want
    assert apply.apply_frames(frames(spark, first)) == {"lsn": 120, "end_lsn": 121}  # sent again
    assert rows(engine.table("orders")) == want
    # the transaction at the checkpoint comes again with a new one; a toasted value stays
    more = [*first[:1], *[("s0", i + 50, f) for i, (_, _, f) in enumerate(log([pgoutput.delete(1, cells(2, 42, None)), pgoutput.insert(1, cells(3, 7, None))], [pgoutput.update(1, cells(1, 0, ...)), pgoutput.update(1, cells(4, 7, "moved"), cells(3, 7, None))], start=120)[1:])]]
    assert apply.apply_frames(frames(spark, more))["lsn"] == 130
    assert rows(engine.table("orders")) == [(1, 0, "a2"), (4, 7, "moved")]


@pytest.mark.parametrize("bad", [[pgoutput.update(1, cells(9, 9, "x"))], [pgoutput.delete(1, cells(9, 9, None))], [pgoutput.insert(1, cells(1, 0, "again"))], [pgoutput.insert(1, cells(8, 8, ...))], [b"T\0\0\0\1\0\0\0\0\1"], [b"S\0\0\0\1\1"], [pgoutput.insert(2, [b"1"])], [pgoutput.insert(1, [b"1"])]])
def test_drift_stops_the_batch_whole(spark, engine, bad):
    apply = Applier(engine.store, "c", KEYS, SHARDS)
    apply.apply_frames(frames(spark, log([pgoutput.insert(1, cells(1, 0, "a"))])))
    with pytest.raises(Exception):  # noqa: B017
        apply.apply_frames(frames(spark, log([pgoutput.insert(1, cells(5, 5, "fine"))], bad, start=200)))
    assert rows(engine.table("orders")) == [(1, 0, "a")] and apply.progress()["lsn"] == 100


def test_range_filter_and_crossing(spark, engine):
    upper = KeyRange(1 << 63)
    apply = Applier(engine.store, "c", KEYS, SHARDS)
    options = {"r": upper, "shard_keys": {"public.orders": ("customer_id", "int")}}
    apply.apply_frames(frames(spark, log([pgoutput.insert(1, cells(i, i, "n")) for i in range(20)], [pgoutput.delete(1, cells(1, 1, None))])), **options)
    from keyspan.functions.keyspace import keyspace_id

    assert [r[0] for r in rows(engine.table("orders"))] == [i for i in range(20) if keyspace_id(i) in upper and i != 1]
    with pytest.raises(Exception, match="edge"):
        apply.apply_frames(frames(spark, log([pgoutput.update(1, cells(0, 1, "n"), cells(0, 0, None))], start=300)), **options)


def test_follow_a_stream(spark, engine, tmp_path):
    source, done = tmp_path / "log", str(tmp_path / "cp")
    frames(spark, log([pgoutput.insert(1, cells(1, 0, "a"))])).coalesce(1).write.parquet(str(source / "1"))
    schema = "shard string, seq long, frame binary"
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    apply = Applier(engine.store, "c", KEYS, SHARDS)
    apply.follow(stream(), done).awaitTermination(120)
    frames(spark, log([pgoutput.update(1, cells(1, 0, "b"))], start=200)).coalesce(1).write.parquet(str(source / "2"))
    apply.follow(stream(), done).awaitTermination(120)
    assert rows(engine.table("orders")) == [(1, 0, "b")]


def test_reshard_copy_is_a_partition_of_the_source(spark, engine, tmp_path):
    rng = random.Random(5)
    engine.insert("orders", spark.createDataFrame([(i, rng.randint(-1000, 1000), f"n{i}") for i in range(200)], SCHEMA))
    parts = KeyRange().split_evenly(3)
    got = []
    for i, r in enumerate(parts):
        target = Store(spark, str(tmp_path / f"t{i}"))
        target.create("public.orders", T._parse_datatype_string(SCHEMA), DEFS[TableName("public", "orders")])
        copy_range(engine.store, target, "public.orders", r, "customer_id", "int", SHARDS)
        got += rows(target.read("public.orders"))
    assert sorted(got) == rows(engine.table("orders"))


def test_frames_as_a_stream_with_offsets(spark, engine, tmp_path):
    """Segments are read once each, a stream that is started again goes on after the last, and what is done is acknowledged."""
    spark.dataSource.register(framelog.FrameSource)
    folder, apply = str(tmp_path / "log"), Applier(engine.store, "segments", KEYS, SHARDS)

    def segment(first, *transactions, start):
        rows = [f for _, _, f in log(*transactions, start=start)]
        return framelog.write_segment(folder, "s0", first, map(bytes, rows))

    def run():
        stream = spark.readStream.format(framelog.FORMAT).option("path", folder).load()
        apply.follow(stream, str(tmp_path / "cp")).awaitTermination()

    base = engine.store.read("public.orders").count()
    one = segment(0, [pgoutput.insert(1, cells(900, 5, "a"))], [pgoutput.insert(1, cells(901, 6, "b"))], start=100)
    run()
    assert engine.store.read("public.orders").count() == base + 2
    two = segment(50, [pgoutput.delete(1, [b"900", b"5", None])], start=300)
    (tmp_path / "log/s0/.unfinished").write_bytes(b"x")
    run()
    run()
    left = {r["id"] for r in engine.store.read("public.orders").collect()}
    assert 901 in left and 900 not in left and one < two
    assert framelog.acknowledged(folder).get("s0", one) in (one, two)
    reader = framelog.FrameReader(folder)
    reader.commit({"s0": two})
    reader.commit({"s0": one})  # never back
    assert framelog.acknowledged(folder) == {"s0": two} and [x.name for x in reader.partitions({"s0": one}, reader.latestOffset())] == [two]
