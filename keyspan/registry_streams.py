"""Registered queries of change streams: frames, transactions, applied changes, one stream over all shards, resharding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan import oracle
from keyspan.functions.keyspace import KeyRange
from keyspan.operators.reshard import Reshard
from keyspan.plans.catalog import ShardCatalog, TableDef
from keyspan.registering import SHARDS, registered, table
from keyspan.registry import _NET, change_log
from keyspan.sources import pgoutput
from keyspan.sources.scratch import kept, scratch
from keyspan.sources.store import Store
from keyspan.streaming import vstream
from keyspan.streaming.apply import Applier
from keyspan.streaming.changes import ROW_OPS, net_changes, row_changes, steps, transactions

# --- frames, built as columns -----------------------------------------------------------------------------------------


def _int(value, size: int) -> Column:
    """An integer in network order."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def _raw(text: str | bytes) -> Column:
    return F.lit(text if isinstance(text, bytes) else text.encode())


def _row(cells: list[Column]) -> Column:
    return F.concat(_int(len(cells), 2), *cells)


def _cell(text: Column) -> Column:
    raw = text.cast("string").cast("binary")
    return F.coalesce(F.concat(_raw("t"), _int(F.octet_length(raw), 4), raw), _raw("n"))


RELATION = pgoutput.relation(7, "public", "last_event", [("user_id", 20, True), ("event_id", 20, False), ("event_type", 25, False)])


def frames_of(events: DataFrame) -> DataFrame:
    """(shard, seq, frame): the changes of change_log as a database would send them, one transaction an event, in four shards."""
    from pyspark.sql import Window as W

    e = events.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) % 4)
    key = F.concat(_raw("K"), _row([_cell(F.col("user_id")), _raw("n"), _raw("n")]))
    new = F.concat(_raw("N"), _row([_cell(F.col("user_id")), _cell(F.col("event_id")), F.when(F.col("r") == 2, _raw("u")).otherwise(_cell(F.col("event_type")))]))
    change = F.when(F.col("r") == 0, F.concat(_raw("D"), _int(7, 4), key)).when(F.col("r") == 1, F.concat(_raw("I"), _int(7, 4), new)).otherwise(F.concat(_raw("U"), _int(7, 4), new))
    lsn, time = F.col("event_id") * 10 + 100, F.unix_micros(F.col("ts").cast("timestamp")) - 946_684_800_000_000
    begin = F.concat(_raw("B"), _int(lsn, 8), _int(time, 8), _int(F.col("event_id") + 1, 4))
    commit = F.concat(_raw("C"), _int(0, 1), _int(lsn, 8), _int(lsn + 5, 8), _int(time, 8))
    shard = F.concat(F.lit("s"), F.col("user_id") % 4)
    rows = e.select(shard.alias("shard"), F.posexplode(F.array(begin, change, commit)).alias("i", "frame"), "event_id")
    rows = rows.select("shard", (F.col("event_id") * 4 + F.col("i")).alias("seq"), "frame")
    return rows.unionByName(e.select(shard.alias("shard")).distinct().select("shard", F.lit(-1).cast("long").alias("seq"), F.lit(RELATION).alias("frame")))


_STEPS = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 4 AS r FROM events) "


@registered(
    _STEPS + "SELECT 's' || (user_id % 4) AS shard, event_id * 4 + 1 AS seq, event_id * 10 + 100 AS commit_lsn, event_id * 10 + 105 AS end_lsn, CASE r WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'update' END AS op, "
    "CASE WHEN r > 0 THEN user_id END AS \"key\", CASE WHEN r <> 1 THEN user_id END AS old_key, CASE WHEN r > 0 THEN event_id END AS event_id, CASE WHEN r IN (1, 3) THEN event_type END AS event_type, CASE r WHEN 0 THEN NULL WHEN 2 THEN 'unchanged' ELSE 'text' END AS kind FROM e"
)
def cdc_decode_changes(spark, sf_dir):
    """Frames to committed row changes: begin, relation, insert, update with an unchanged cell, delete by key, commit."""
    found = row_changes(transactions(pgoutput.decode_frames(frames_of(table(spark, sf_dir, "events"))), ROW_OPS))
    cell = lambda i, of: F.get("cells", F.lit(i))[of]
    return found.select("shard", "seq", "commit_lsn", "end_lsn", "op", F.col("key")[0].cast("long").alias("key"), F.col("old_key")[0].cast("long").alias("old_key"), cell(1, "value").cast("long").alias("event_id"), cell(2, "value").alias("event_type"), cell(2, "kind").alias("kind"))


@registered("SELECT 's' || (user_id % 4) AS shard, event_id * 4 AS seq, event_id + 1 AS xid, event_id * 10 + 100 AS commit_lsn, ts FROM events")
def cdc_decode_begins(spark, sf_dir):
    found = pgoutput.decode_frames(frames_of(table(spark, sf_dir, "events"))).filter("op = 'begin'")
    return found.select("shard", "seq", "xid", "commit_lsn", pgoutput.commit_time().cast("timestamp_ntz").alias("ts"))


@registered(_NET)
def cdc_from_frames(spark, sf_dir):
    """Frames decoded, put together by transaction, and folded to each key's last state."""
    found = row_changes(transactions(pgoutput.decode_frames(frames_of(table(spark, sf_dir, "events"))), ROW_OPS))
    net = net_changes(steps(found), spark.createDataFrame([], "key array<string>"))
    value = lambda i: F.col("cells")[i]["value"]
    return net.filter("op = 'upsert'").select(value(0).cast("long").alias("user_id"), value(1).cast("long").alias("event_id"), value(2).alias("event_type"))


@registered(_NET)
def cdc_apply_frames(spark, sf_dir):
    """Frames applied to a stored table in two batches, the second with the first's once more, then all again."""
    events = table(spark, sf_dir, "events")
    frames = kept(frames_of(events), "sent")  # a log is written once, however often it is sent
    store = Store(spark, scratch(spark, "apply"))
    store.create("public.last_event", T._parse_datatype_string("user_id bigint, event_id bigint, event_type string"), TableDef("user_id", "int"))
    apply = Applier(store, "frames", {"public.last_event": ["user_id"]}, SHARDS)
    half = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    for part in (frames.filter(F.col("seq") < half * 4), frames, frames):
        apply.apply_frames(part)
    return store.read("public.last_event")


@registered(oracle.positions("SELECT user_id AS k FROM events") + f", net AS ({_NET.replace('WITH e AS', 'WITH e AS MATERIALIZED')}) SELECT net.* FROM net JOIN placed ON user_id = k WHERE id < {1 << 63}::UBIGINT")
def cdc_apply_range(spark, sf_dir):
    """The changes of one half of the keyspace, followed into a target of its own."""
    store = Store(spark, scratch(spark, "apply"))
    store.create("public.last_event", T._parse_datatype_string("user_id bigint, event_id bigint, event_type string"), TableDef("user_id", "int"))
    apply = Applier(store, "target", {"public.last_event": ["user_id"]}, SHARDS)
    apply.apply_frames(frames_of(table(spark, sf_dir, "events")), KeyRange(0, 1 << 63), {"public.last_event": ("user_id", "int")})
    return store.read("public.last_event")


def _tagged(n: Column) -> list[Column]:
    """A frame of every tag with n in its fields, in an order in which a stream opens and closes."""
    text = F.concat(F.lit("t"), n).cast("binary")
    ended = F.concat(text, _raw(b"\0"))
    row = F.concat(_raw("N"), _row([_cell(n), _raw("n"), _raw("u"), F.concat(_raw("b"), _int(2, 4), _raw(b"\1\2"))]))
    old = F.concat(_raw("O"), _row([_cell(n)]))
    at = F.concat(_int(n + 1, 8), _int(n + 2, 8), _int(n + 3, 8), _int(n + 4, 4))
    relation = F.concat(_int(n, 4), _raw(b"public\0"), ended, _raw("d"), _int(1, 2), _int(1, 1), _raw(b"id\0"), _int(23, 4), _raw(b"\xff\xff\xff\xff"))
    message = F.concat(_int(1, 1), _int(n + 1, 8), _raw(b"p\0"), _int(F.octet_length(text), 4), text)
    inside = _int(n + 9, 4)
    return [
        F.concat(_raw("B"), _int(n + 1, 8), _int(n + 3, 8), _int(n + 4, 4)), F.concat(_raw("O"), _int(n + 1, 8), ended), F.concat(_raw("R"), relation), F.concat(_raw("Y"), _int(n, 4), _raw(b"public\0"), ended),
        F.concat(_raw("I"), _int(n, 4), row), F.concat(_raw("U"), _int(n, 4), old, row), F.concat(_raw("D"), _int(n, 4), old), F.concat(_raw("T"), _int(2, 4), _int(3, 1), _int(n, 4), _int(n + 1, 4)), F.concat(_raw("M"), message),
        F.concat(_raw("C"), _int(0, 1), _int(n + 1, 8), _int(n + 2, 8), _int(n + 3, 8)), F.concat(_raw("S"), inside, _int(1, 1)), F.concat(_raw("I"), inside, _int(n, 4), row), F.concat(_raw("M"), inside, message), _raw("E"),
        F.concat(_raw("c"), inside, _int(0, 1), _int(n + 1, 8), _int(n + 2, 8), _int(n + 3, 8)), F.concat(_raw("A"), inside, _int(n + 5, 4)), F.concat(_raw("b"), at, ended), F.concat(_raw("P"), _int(0, 1), at, ended),
        F.concat(_raw("K"), _int(0, 1), at, ended), F.concat(_raw("r"), _int(0, 1), _int(n + 1, 8), _int(n + 2, 8), _int(0, 8), _int(n + 3, 8), _int(n + 4, 4), ended), F.concat(_raw("p"), _int(0, 1), at, ended),
    ]


_TAGS = (
    "begin origin relation type insert update delete truncate message commit stream_start insert message stream_stop stream_commit stream_abort begin_prepare prepare commit_prepared rollback_prepared stream_prepare".split()
)
_PREPARED = "('begin_prepare', 'prepare', 'commit_prepared', 'rollback_prepared', 'stream_prepare')"


@registered(
    f"WITH tags(i, op) AS (VALUES {', '.join(f'({i}, {chr(39)}{t}{chr(39)})' for i, t in enumerate(_TAGS))}), f AS (SELECT s_suppkey AS n, i, op, i IN (11, 12) AS inside FROM supplier, tags) "
    f"SELECT 's' || (n % 3) AS shard, n * 100 + i AS seq, op, CASE WHEN op = 'begin' OR op IN {_PREPARED} THEN n + 4 WHEN inside OR op IN ('stream_start', 'stream_commit', 'stream_abort') THEN n + 9 END AS xid, "
    f"CASE WHEN op IN ('begin', 'origin', 'commit', 'message', 'stream_commit') OR op IN {_PREPARED} THEN n + 1 END AS commit_lsn, CASE WHEN op IN ('commit', 'stream_commit') OR op IN {_PREPARED} THEN n + 2 END AS end_lsn, CASE WHEN op IN ('begin', 'commit', 'stream_commit') OR op IN {_PREPARED} THEN n + 3 END AS ts, "
    "CASE WHEN op IN ('relation', 'type', 'insert', 'update', 'delete') THEN n END AS rel_oid, CASE WHEN op IN ('relation', 'type') THEN 't' || n END AS \"table\", CASE WHEN op = 'origin' THEN 't' || n WHEN op = 'message' THEN 'p' END AS prefix, CASE WHEN op = 'message' THEN 't' || n END AS content, "
    f"CASE WHEN op IN {_PREPARED} THEN 't' || n END AS gid, CASE WHEN op = 'stream_abort' THEN n + 5 END AS subxid, CASE WHEN op = 'truncate' THEN n || ',' || (n + 1) END AS relations, CASE WHEN op = 'relation' THEN 'id 23 d' END AS columns, "
    "CASE WHEN op IN ('update', 'delete') THEN 'full text ' || n END AS before, CASE WHEN op IN ('insert', 'update') THEN 'text ' || n || ',null,unchanged,binary' END AS after FROM f"
)
def cdc_decode_tags(spark, sf_dir):
    """Frames of all 19 tags, inside and outside a stream bracket, decoded field by field."""
    n = F.col("s_suppkey")
    frames = F.posexplode(F.array(*_tagged(n))).alias("i", "frame")
    rows = table(spark, sf_dir, "supplier").select(n, frames).select(F.concat(F.lit("s"), n % 3).alias("shard"), (n * 100 + F.col("i")).alias("seq"), "frame")
    d = pgoutput.decode_frames(rows)
    text = lambda c: F.decode(c, "UTF-8")
    kinds = lambda c: F.array_join(F.transform(c, lambda x: F.when(x["kind"] == "text", F.concat(x["kind"], F.lit(" "), text(x["value"]))).otherwise(x["kind"])), ",")
    columns = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type_oid"])), ",")
    return d.select(
        "shard", "seq", "op", "xid", "commit_lsn", "end_lsn", "ts", "rel_oid", "table", "prefix", text("content").alias("content"), "gid", "subxid", F.array_join(F.transform("relations", lambda x: x.cast("string")), ",").alias("relations"),
        F.when(F.col("op") == "relation", F.concat_ws(" ", columns, "replica_identity")).alias("columns"), F.concat(F.col("before_kind"), F.lit(" "), kinds("before")).alias("before"), kinds("after").alias("after"),
    )


# --- one stream over all shards ---------------------------------------------------------------------------------------


def _shard_log(spark, sf_dir) -> DataFrame:
    return change_log(table(spark, sf_dir, "events")).withColumn("shard", F.concat(F.lit("s"), F.col("seq") % 4))


@registered(
    "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 4 AS r FROM events), c AS (SELECT 's' || (event_id % 4) AS shard, event_id AS commit_lsn, event_id AS seq, CASE r WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'update' END AS op FROM e) "
    "SELECT shard, commit_lsn, seq * 2 AS n, 'begin' AS kind, NULL AS op FROM c UNION ALL SELECT shard, commit_lsn, seq * 2 + 1, 'row', op FROM c UNION ALL SELECT shard, commit_lsn, seq * 2 + 2, 'commit', NULL FROM c"
)
def vstream_events(spark, sf_dir):
    """Begin, row and commit events of every shard, in the order that they are sent."""
    return vstream.events(_shard_log(spark, sf_dir)).select("shard", "commit_lsn", "n", "kind", "op")


@registered("WITH p AS (SELECT event_id % 4 AS s, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1) SELECT 's' || s AS shard, event_id AS seq FROM events JOIN p ON s = event_id % 4 WHERE s <> 3 AND event_id > CASE s WHEN 0 THEN lo WHEN 1 THEN (lo + hi) // 2 ELSE hi END")
def vstream_resume(spark, sf_dir):
    """A stream resumed at a position: strictly after each shard's commit, nothing of a shard that it doesn't name."""
    log = _shard_log(spark, sf_dir)
    ends = {r["shard"]: r for r in log.groupBy("shard").agg(F.min("commit_lsn").alias("lo"), F.max("commit_lsn").alias("hi")).collect()}
    at = {"s0": ends["s0"]["lo"], "s1": (ends["s1"]["lo"] + ends["s1"]["hi"]) // 2, "s2": ends["s2"]["hi"]}
    position = vstream.Position.from_json(vstream.Position(at).to_json())
    return vstream.start(vstream.POSITION, log, position=position).select("shard", "seq")


@registered("SELECT 'public' AS schema, 'last_event' AS \"table\", 'user_id,event_id,event_type' AS columns, (SELECT count(*) FROM events) AS changes, 0 AS after_latest")
def vstream_fields(spark, sf_dir):
    log = _shard_log(spark, sf_dir)
    after = vstream.start(vstream.LATEST, log).count()
    fields = vstream.field_events(vstream.start(vstream.SNAPSHOT, log, ["public.last_event"]))
    return fields.select("schema", "table", F.array_join("columns", ",").alias("columns"), F.lit(log.count()).alias("changes"), F.lit(after).alias("after_latest"))


@registered("SELECT 's' || n_nationkey AS shard, 'heartbeat' AS kind FROM nation WHERE n_nationkey NOT IN (SELECT event_id % 4 FROM events)")
def vstream_heartbeats(spark, sf_dir):
    shards = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("shard"))
    return vstream.heartbeats(shards, _shard_log(spark, sf_dir))


@registered("SELECT 's0' AS shard, s_suppkey * 10 + 1 AS commit_lsn, 'ddl' AS kind, 'm' || s_suppkey AS migration_id, 'ALTER TABLE t ADD c' || s_suppkey || ' int' AS sql FROM supplier WHERE s_suppkey % 2 = 0")
def vstream_ddl(spark, sf_dir):
    """Schema statements that travel in the stream as messages, with other messages between them."""
    n = F.col("s_suppkey")
    content = F.concat(F.lit("m"), n, F.lit("\nALTER TABLE t ADD c"), n, F.lit(" int")).cast("binary")
    prefix = F.when(n % 2 == 0, _raw(b"keyspan.ddl\0")).otherwise(_raw(b"other\0"))
    message = F.concat(_raw("M"), _int(1, 1), _int(n * 10 + 1, 8), prefix, _int(F.octet_length(content), 4), content)
    begin, commit = F.concat(_raw("B"), _int(n * 10 + 1, 8), _int(0, 8), _int(1, 4)), F.concat(_raw("C"), _int(0, 1), _int(n * 10 + 1, 8), _int(n * 10 + 2, 8), _int(0, 8))
    rows = table(spark, sf_dir, "supplier").select(n, F.posexplode(F.array(begin, message, commit)).alias("i", "frame"))
    frames = rows.select(F.lit("s0").alias("shard"), (n * 3 + F.col("i")).alias("seq"), "frame")
    return vstream.ddl_events(transactions(pgoutput.decode_frames(frames)))


@registered("SELECT * FROM (VALUES ('40-60', 7), ('60-80', 9), ('80-c0', 5), ('c0-', 6), ('-40', 3)) v(shard, lsn)")
def vstream_journal(spark, sf_dir):
    """A shard that ends hands its stream to its successors, each from its own start; copies are told once."""
    position = vstream.Position({n: i + 3 for i, n in enumerate(("-40", "40-80", "80-c0", "c0-"))})
    position = position.journal("40-80", [("60-80", KeyRange.parse("60-80"), 9), ("40-60", KeyRange.parse("40-60"), 7)], KeyRange.parse("40-80"))
    position, told = vstream.copy_completed(position, ["public.a", "public.b", "public.a"])
    assert told == [("copy_completed", "public.a"), ("copy_completed", "public.b")] and not vstream.copy_completed(position, ["public.a"])[1]
    assert vstream.covers({n: KeyRange.parse(n) for n in position.shards}, position)
    return spark.createDataFrame(sorted(position.shards.items()), "shard string, lsn int")


# --- resharding -------------------------------------------------------------------------------------------------------

_AFTER = ShardCatalog.of([("-40", KeyRange.parse("-40")), ("40-55", KeyRange.parse("40-55")), ("55-60", KeyRange.parse("55-60")), ("60-80", KeyRange.parse("60-80")), ("80-c0", KeyRange.parse("80-c0")), ("c0-", KeyRange.parse("c0-"))])


@registered(
    oracle.positions("SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
    + f"\nSELECT 'orders' AS \"table\", {oracle.shard_case(_AFTER)} AS shard, o_orderkey AS row, o_custkey AS \"key\" FROM orders JOIN placed ON o_custkey = k UNION ALL SELECT 'customer', {oracle.shard_case(_AFTER)}, c_custkey, c_custkey FROM customer JOIN placed ON c_custkey = k"
)
def reshard_switch(spark, sf_dir):
    """Two stored tables whose shard 40-80 is split in three while rows are still being added, then switched at once."""
    store = Store(spark, scratch(spark, "reshard"))
    parts = {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "customer": table(spark, sf_dir, "customer").select("c_custkey")}
    key = {"orders": "o_custkey", "customer": "c_custkey"}
    for name, rows in parts.items():
        store.create(f"public.{name}", rows.schema, TableDef(key[name], "int"))
        store.append(f"public.{name}", rows.filter(F.col(key[name]) % 10 != 3), SHARDS)
    split = Reshard(store, "40-80", [(n, r) for n, r in _AFTER.shards if n in ("40-55", "55-60", "60-80")], SHARDS)
    split.seed()
    for name, rows in parts.items():  # written while the first pass is done
        store.append(f"public.{name}", rows.filter(F.col(key[name]) % 10 == 3), SHARDS)
    split.run()
    read = lambda name, row: store.read(f"public.{name}", with_shard=True).select(F.lit(name).alias("table"), "shard", F.col(row).alias("row"), F.col(key[name]).alias("key"))
    return read("orders", "o_orderkey").unionByName(read("customer", "c_custkey"))


@registered("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'keepalive' ELSE 'wal' END AS kind, CASE WHEN event_id % 4 <> 0 THEN event_id * 7 - 20 END AS wal_start, event_id * 7 AS wal_end, event_id + 5 AS server_time, CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END AS reply, CASE WHEN event_id % 4 <> 0 THEN event_type END AS frame FROM events")
def wal_envelopes(spark, sf_dir):
    """Messages of a replication connection taken apart: positions, time, and the frame or whether an answer is wanted."""
    n = F.col("event_id")
    wal = F.concat(_raw("w"), _int(n * 7 - 20, 8), _int(n * 7, 8), _int(n + 5, 8), F.col("event_type").cast("binary"))
    alive = F.concat(_raw("k"), _int(n * 7, 8), _int(n + 5, 8), F.when(n % 8 == 0, _raw(b"\1")).otherwise(_raw(b"\0")))
    messages = table(spark, sf_dir, "events").select("event_id", F.when(n % 4 == 0, alive).otherwise(wal).alias("data"))
    return pgoutput.unwrap(messages).withColumn("frame", F.decode("frame", "UTF-8"))
