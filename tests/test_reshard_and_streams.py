import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions.keyspace import KeyRange, keyspace_id
from keyspan.operators.reshard import Reshard, check_workflow
from keyspan.plans.catalog import GLOBAL, ShardCatalog, TableDef, TopologyError
from keyspan.registry import change_log
from keyspan.sources.store import Conflict, Fenced, Store, StoreError
from keyspan.sources.topology_file import Watcher, load
from keyspan.streaming import vstream as V

DOC = {"epoch": 1, "topologyGeneration": 1, "writeLeaseSeconds": 10, "hashFunction": "xxhash64_v1", "shards": [{"name": "s0", "keyRange": {"start": "", "end": ""}, "state": "Serving"}], "tables": []}


def test_a_watched_topology(tmp_path):
    path, clock = tmp_path / "t.json", [0.0, 1000.0]
    w = Watcher(str(path), boot=lambda: clock[0], wall=lambda: clock[1])

    def put(**change):
        path.write_text(json.dumps(DOC | change))

    assert not w.poll() and w.topology is None and not w.may_write()
    put()
    assert w.poll() and w.may_write()
    clock[:] = [9, 1009]
    assert not w.poll() and w.may_write()  # the same: confirmed
    clock[:] = [18, 1018]
    put(epoch=0)
    assert not w.poll() and w.may_write()
    put(epoch=2, gates=[{"id": "g"}])  # sound, but no router is built from it
    assert not w.poll() and w.topology.epoch == 1 and "gates" in w.fault
    clock[:] = [19, 1019]
    assert not w.may_write()  # not confirmed any more
    put(epoch=3)
    assert w.poll() and w.topology.epoch == 3 and w.may_write()
    put(epoch=2)
    assert not w.poll() and w.topology.epoch == 3
    path.write_text("{")
    with pytest.raises(TopologyError):
        load(str(path))


def test_positions():
    p = V.Position({"a": 5, "b": 7}, frozenset({"t"}))
    assert V.Position.from_json(p.to_json()) == p and p.after("a", 3).shards["a"] == 5 and p.after("a", 9).shards["a"] == 9
    parts = KeyRange().split_evenly(2)
    assert p.journal("a", [("c", parts[0], 11), ("d", parts[1], 12)], KeyRange()).shards == {"b": 7, "c": 11, "d": 12}
    for bad in ([], [("c", parts[0], 1)], [("b", parts[0], 1), ("d", parts[1], 1)]):
        with pytest.raises(V.StreamError):
            p.journal("a", bad, KeyRange())
    assert V.covers({"a": parts[0], "b": parts[1]}, p) and not V.covers({"a": parts[0]}, p)


def test_streams_resume_strictly_after(spark):
    rows = spark.createDataFrame([(i, i % 3, f"e{i}") for i in range(12)], "event_id long, user_id long, event_type string")
    log = change_log(rows)
    after = V.start(V.POSITION, log, position=V.Position({"s0": 7}))
    assert sorted(r["seq"] for r in after.collect()) == [8, 9, 10, 11]
    assert V.start(V.LATEST, log).count() == 0 and V.start(V.SNAPSHOT, log).count() == 12
    assert V.start(V.SNAPSHOT, log, ["public.other"]).count() == 0 and V.follow(log, V.Position({"zz": 0})).count() == 0
    for kind, position in (("", None), (V.POSITION, None)):
        with pytest.raises(V.StreamError):
            V.start(kind, log, position=position)
    kinds = [r["kind"] for r in V.events(after).orderBy("shard", "commit_lsn", "n").collect()]
    assert kinds == ["begin", "row", "commit"] * 4
    assert V.field_events(log).first()["columns"] == ["user_id", "event_id", "event_type"]


SCHEMA = "id bigint, customer_id int"


def store_of(spark, path):
    store, catalog = Store(spark, str(path)), ShardCatalog.even(2)
    for t in ("public.orders", "public.items"):
        store.create(t, T._parse_datatype_string(SCHEMA), TableDef("customer_id", "int"))
        store.append(t, spark.range(100).select("id", F.col("id").cast("int").alias("customer_id")), catalog)
    store.create("public.settings", T._parse_datatype_string("a int"), GLOBAL)
    return store, catalog


def test_a_split_while_writes_go_on(spark, tmp_path):
    store, catalog = store_of(spark, tmp_path / "s")
    parts = dict(catalog.shards)["80-"].split_evenly(2)
    reshard = Reshard(store, "80-", [(str(r), r) for r in parts], catalog)
    assert reshard.seed() == 2
    store.append("public.orders", spark.range(100, 130).select("id", F.col("id").cast("int").alias("customer_id")), catalog)
    with pytest.raises(Conflict):  # rows came meanwhile
        reshard.switch()
    assert reshard.seed() == 1 and reshard.seed() == 0 and reshard.phase == "ReadyToCutover"
    source = store.read("public.orders", ["80-"]).count()
    assert reshard.counts()["public.orders"] == source
    manifest = reshard.switch()
    assert manifest["state"]["generation"] == 2 and reshard.attempts == 2 and reshard.phase == "SwitchedForward"
    assert sorted(r["id"] for r in store.read("public.orders").collect()) == list(range(130))
    assert store.read("public.orders", ["80-"]).count() == 0
    for name, r in [("-80", KeyRange(0, 1 << 63)), *[(str(r), r) for r in parts]]:
        assert all(keyspace_id(x["customer_id"]) in r for x in store.read("public.orders", [name]).collect())


def test_reshards_that_are_refused(spark, tmp_path):
    store, catalog = store_of(spark, tmp_path / "s")
    with pytest.raises(StoreError):
        Reshard(store, "nope", [], catalog)
    with pytest.raises(ValueError):
        Reshard(store, "80-", [("x", KeyRange(1 << 63))], catalog)
    schema = {"t": TableDef("k", "int"), "g": GLOBAL}
    check_workflow({"id": "w", "range": "80-", "tables": [{"name": "t"}]}, schema)
    for bad in ({}, {"id": "w"}, {"id": "w", "range": "80-"}, *[{"id": "w", "range": "80-", "tables": t} for t in ([{"name": "g"}], [{"name": "t"}, {"name": "t"}], [{"name": "t", "key": "x"}], [{"name": "t", "target": "u"}])]):
        with pytest.raises((ValueError, StoreError)):
            check_workflow(bad, schema)


def test_fences(spark, tmp_path):
    """A fenced shard takes no writes, one claim at a time, and only its claim lets it go."""
    store, shards = Store(spark, str(tmp_path / "f")), ShardCatalog.even(4)
    rows = spark.range(100).withColumnRenamed("id", "k")
    store.create("public.t", rows.schema, TableDef("k", "int"))
    store.append("public.t", rows, shards)
    held = shards.all()[0]
    store.fence(held, "one")
    store.fence(held, "one")
    with pytest.raises(Conflict):
        store.fence(held, "two")
    with pytest.raises(Fenced) as error:
        store.append("public.t", rows, shards)
    assert error.value.code == "25006" and store.read("public.t").count() == 100
    others = store.read("public.t", shards.all()[1:])
    store.append("public.t", others, shards)
    assert not store.unfence(held, "two") and store.unfence(held, "one") and not store.unfence(held, "one")
    store.append("public.t", rows, shards)
    split = Reshard(store, held, [("a", KeyRange(0, 1 << 61)), ("b", KeyRange(1 << 61, 1 << 62))], shards)
    store.fence(held, "someone else")
    with pytest.raises(Conflict):
        split.freeze()
    assert not split.rollback() and split.phase == "CatchingUp"
