import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyspan import registry
from keyspan.functions.keyspace import KeyRange, KeyspaceError
from keyspan.operators import control as C
from keyspan.operators import election as E
from keyspan.operators import instance_config as I
from keyspan.operators import temporal as R
from keyspan.operators import topology as T
from keyspan.operators.merge import concat, merge
from keyspan.operators.running import last_value, running_sum
from keyspan.plans.catalog import Topology, TopologyError
from keyspan.plans.scatter import SortKey
from keyspan.plans.sql import SqlError

# --- restores -------------------------------------------------------------------------------------------------------


def at(hours):
    return datetime(2025, 3, 3) + timedelta(hours=hours)


SHARD, SAVED, POINT = "name:string,stanza:string,role:string,state:string", "name:string,stanza:string,label:string,stop_lsn:string,timeline:int,stop_time:timestamp", "name:string,stanza:string,lsn:string,timeline:int,restore_point:string"


@pytest.fixture
def catalog(spark):
    """Two shards and a system shard, of which the first is split on the second day: a backup and a barrier on either."""
    days = [(1, ["north", "south", "meta"]), (2, ["north-low", "north-high", "south", "meta"])]
    home = lambda n: f"home/{n}"
    tables = [("public", "visits", "sharded", "visitor", "uuid"), ("public", "countries", "global", None, None)]
    topologies = [(g, at(24 * (g - 1)), 5 * g, "xxhash64_v1", [(n, home(n), "system" if n == "meta" else "data", "Serving") for n in names], tables) for g, names in days]
    backups = [(f"night{g}", at(24 * g - 18), g, [(n, home(n), f"{n}@{g}", f"{g}/40", 1, at(24 * g - 18 - i)) for i, n in enumerate(names)]) for g, names in days]
    barriers = [(f"noon{g}", at(24 * g - 12), g, [(n, home(n), f"{g}/80", 1, f"mark-{g}") for n in names]) for g, names in days]
    return R.Catalog(
        spark.createDataFrame(topologies, f"generation int, valid_from timestamp, epoch int, hash_function string, shards array<struct<{SHARD}>>, tables array<struct<schema:string,name:string,type:string,shard_key_column:string,shard_key_type:string>>"),
        spark.createDataFrame(barriers, f"id string, time timestamp, topology_generation int, shards array<struct<{POINT}>>"),
        spark.createDataFrame(backups, f"id string, completed_at timestamp, topology_generation int, shards array<struct<{SAVED}>>"),
    )


def plan(catalog, **target):
    return {r["shard"]: r for r in R.resolve(catalog, **target).collect()}


def test_restore_targets(catalog):
    early = plan(catalog, time=at(20))
    assert set(early) == {"north", "south", "meta"} and early["north"]["set"] == "north@1" and early["north"]["target_timeline"] == "latest"
    assert set(plan(catalog, time=at(40))) == {"north-low", "north-high", "south", "meta"}
    named = plan(catalog, barrier="noon1")
    assert named["south"]["target_value"] == "mark-1" and named["south"]["verify_lsn"] == "1/80" and not named["south"]["target_exclusive"]
    stop = plan(catalog, backup="night1")
    assert stop["south"]["target_type"] == "lsn" and stop["south"]["target_exclusive"] and stop["south"]["target_value"] == "1/40"
    assert plan(catalog, latest=True)["north-low"]["set"] == "north-low@2"


@pytest.mark.parametrize("target,why", [({}, "exactly one"), ({"barrier": "noon1", "latest": True}, "exactly one"), ({"barrier": "never"}, "not in the catalog"), ({"time": at(-1)}, "before the first"), ({"time": at(2)}, "old enough"), ({"time": at(25)}, "old enough")])
def test_restores_that_are_refused(catalog, target, why):
    with pytest.raises(R.RestoreError, match=why):
        R.resolve(catalog, **target)


def test_a_catalog_that_contradicts_itself(catalog):
    c = catalog
    with pytest.raises(R.RestoreError, match="more than once"):
        R.resolve(R.Catalog(c.topologies, c.barriers, c.backups.union(c.backups)), latest=True)
    other = c.backups.withColumn("shards", F.transform("shards", lambda s: s.withField("stanza", F.lit("home/south"))))
    with pytest.raises(R.RestoreError, match="would be restored from"):
        R.resolve(R.Catalog(c.topologies, c.barriers, other), backup="night1")
    fewer = c.backups.withColumn("shards", F.slice("shards", 1, 2))
    with pytest.raises(R.RestoreError, match="has no plan"):
        R.resolve(R.Catalog(c.topologies, c.barriers, fewer), backup="night1")
    unhashed = c.topologies.withColumn("hash_function", F.lit("other"))
    with pytest.raises(R.RestoreError, match="not known"):
        R.resolve(R.Catalog(unhashed, c.barriers, c.backups), latest=True)


@pytest.mark.parametrize("few", [1000, 3])
def test_as_of_with_few_and_many_versions(spark, monkeypatch, few):
    """Sent along or merged by time, the same versions are found, ties and times before the first included."""
    monkeypatch.setattr(R, "FEW", few)
    rng = random.Random(4)
    versions = [(at(rng.randint(5, 60)), g) for g in range(1, 40)]
    targets = [(i, at(rng.randint(0, 70))) for i in range(300)] + [(300, None)]
    got = {r["i"]: r["generation"] for r in R.topology_at(spark.createDataFrame(targets, "i int, t timestamp"), spark.createDataFrame(versions, "valid_from timestamp, generation int")).collect()}
    assert got == {i: max(((v, g) for v, g in versions if t and v <= t), default=(None, None))[1] for i, t in targets}
    saved = [(f"s{rng.randint(0, 3)}", f"l{i:02}", at(rng.randint(5, 60))) for i in range(60)]
    wanted = [(i, f"s{rng.randint(0, 4)}", at(rng.randint(0, 70))) for i in range(300)]
    got = {r["i"]: (r["label"], r["stop_time"]) for r in R.newest_backup_before(spark.createDataFrame(wanted, "i int, stanza string, t timestamp"), spark.createDataFrame(saved, "stanza string, label string, stop_time timestamp")).collect()}
    for i, stanza, t in wanted:
        own = [(stop, label) for s, label, stop in saved if s == stanza and stop <= t]
        last = max((stop for stop, _ in own), default=None)
        assert got[i] == (min((label for stop, label in own if stop == last), default=None), last)


def test_running_sums_and_last_values(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(("a", "b", None)), n, rng.choice((None, 1, 2, 5))) for n in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "g string, n int, v int")
    sums = {r["n"]: r["s"] for r in running_sum(df, ["g"], ["n"], F.col("v").cast("long"), "s").collect()}
    last = {r["n"]: r["l"] for r in last_value(df, ["g"], ["n"], F.col("v"), "l").collect()}
    for g, n, _ in rows:
        own = [v for _, v in sorted(((m, v) for h, m, v in rows if h == g and m <= n), key=lambda x: x[0]) if v is not None]
        assert sums[n] == sum(own) and last[n] == (own[-1] if own else None)
    assert running_sum(df.limit(0), ["g"], ["n"], F.col("v").cast("long"), "s").count() == 0
    assert {r["n"]: r["s"] for r in running_sum(df, [], ["n"], F.lit(1), "s").collect()} == {n: i + 1 for i, n in enumerate(sorted(n for _, n, _ in rows))}


# --- control --------------------------------------------------------------------------------------------------------


def test_gates():
    g = C.GateEngine(per_gate=2, total=3, max_wait=5)
    write, read = C.Scope(("orders",), (5,)), C.Scope(("orders",), (5,), False)
    g.close(C.Gate("g", 100, tables=("orders",), min_generation=7))
    assert g.check(read, 0) is None and g.check(C.Scope(("other",)), 0) is None
    a, b = g.check(write, 0), g.check(write, 1)
    assert g.check(write, 2).outcome == C.REJECTED
    g.open("g", 3)  # armed: the generation is not there yet
    assert a.outcome is None
    g.close(C.Gate("g", 100, tables=("orders",), min_generation=7))  # again: keeps what waits
    g.topology_applied(6, 4)
    assert g.status() == [("g", 2)]
    g.topology_applied(7, 4)
    assert (a.outcome, a.generation, b.outcome) == (C.REPLAN, 7, C.REPLAN) and not g.status()
    g.close(C.Gate("late", 10, everything=True))
    c = g.check(write, 5)
    g.open("late", 11)
    assert c.outcome == C.EXPIRED
    g.close(C.Gate("r", 50, ranges=(KeyRange(0, 10),)))
    d, e = g.check(write, 20), g.check(write, 24)
    d.gone = True
    assert g.check(write, 24).outcome is None and g.reject_overdue(29.5) == 2 and e.outcome == C.REJECTED
    assert g.expire_due(50) == 1


def test_decisions_once():
    g = C.EpochGuard()
    assert g.check(3, "promote:a") == "apply"
    g.commit(3, "promote:a")
    assert g.check(3, "promote:a") == "replay" and g.check(4, "x") == "apply"
    for epoch, key in ((0, "x"), (2, "x"), (3, "other")):
        with pytest.raises(C.DecisionError):
            g.check(epoch, key)
    log = C.StatementLog()
    assert log.claim("a", "s") == "execute"
    with pytest.raises(C.DecisionError):
        log.claim("a", "s")
    log.finish("a", ok=False)
    assert log.claim("a", "s") == "execute"
    log.finish("a", ok=True)
    assert log.claim("a", "s") == "replay"
    with pytest.raises(C.DecisionError):
        log.claim("a", "t")
    f = C.Freshness(10)
    assert not f.may_write(0, 0)
    f.confirm(1, 100, 1000)
    assert f.may_write(105, 1005) and not f.may_write(105, 1011) and not f.may_write(111, 1005)
    w = C.Workflows()
    assert w.start("a", 1) and not w.start("a", 1)
    with pytest.raises(C.DecisionError):
        w.start("a", 2)
    w.stop("a")
    assert w.start("a", 2) and w.statuses(["a"]) == {"a": "running"}
    assert C.xid_horizon(4_000_000_000, [100, 3_999_999_999, 4_100_000_000]) == 4_100_000_000


def test_instance_settings():
    r = I.render("L", {" Work_Mem ": "1GB", "max_connections": "'500'", "wal_level": "minimal"}, headroom=4)
    p = r["parameters"]
    assert (p["shared_buffers"], p["work_mem"], p["max_connections"], p["wal_level"], p["max_wal_senders"], p["io_workers"]) == ("16384MB", "1GB", "'500'", "logical", "7", "4")
    assert I.render("S", {"max_connections": "50"})["parameters"]["work_mem"] == "20MB"
    assert I.render("S")["parameters"]["work_mem"] == "10MB" and I.render("S")["synchronous"] == ("off", 0)
    assert I.render("M")["hash"] == I.render("")["hash"] != I.render("M", {"work_mem": "1GB"})["hash"]
    for bad in ({"archive_command": "x"}, {"a b": "x"}, {"a": "x\ny"}, {"A": "1", "a": "2"}):
        with pytest.raises(I.ConfigError):
            I.clean_settings(bad)
    with pytest.raises(I.ConfigError):
        I.render("M", synchronous=("quorum", 3))
    assert I.changes({"work_mem": "1", "a": "1", "x": "1"}, {"work_mem": "2", "b": "1", "x": "1"}) == (["work_mem"], ["a", "b"])


def test_catch_up(spark):
    rows = [("a", 100, 90), ("a", 100, 95), ("b", 100, None), ("c", 100, 101), ("d", 1 << 30, 5)]
    got = {r["source"]: (r["lag"], r["caught_up"]) for r in E.catch_up(spark.createDataFrame(rows, "source string, write_lsn long, applied_lsn long")).collect()}
    assert got == {"a": (10, True), "b": (None, False), "c": (None, False), "d": ((1 << 30) - 5, False)}


def test_lsns(spark):
    df = spark.createDataFrame([("0/0",), ("16/B374D848",), ("FFFFFFFF/FFFFFFFF",), ("x/1",), ("1",)], "t string")
    got = [r["n"] for r in df.select(T.lsn(F.col("t")).alias("n")).collect()]
    assert [None if n is None else int(n) for n in got] == [0, (0x16 << 32) + 0xB374D848, (1 << 64) - 1, None, None]


def test_queries_and_sql_go_together():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(registry.queries()) == len(registry.oracle_sql()) and len(queries) >= len(registry.queries())
