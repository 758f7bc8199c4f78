"""Registered queries of the engine's own operators, and the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan import oracle
from keyspan.engine import NATIVE, STRICT
from keyspan.functions import keyspace as K
from keyspan.functions.keyspace import KeyRange
from keyspan.operators import election, placement, temporal, topology
from keyspan.operators.merge import merge, order
from keyspan.operators.sequences import number_rows
from keyspan.plans.catalog import ShardCatalog, TableDef, TableName
from keyspan.plans.scatter import SortKey
from keyspan.registering import ORACLES, QUERIES, SCHEMA, SHARDS, engine, registered, table
from keyspan.sources import copytext
from keyspan.sources.scratch import scratch
from keyspan.sources.store import Store
from keyspan.streaming.apply import Applier
from keyspan.streaming.changes import keep_range, net_changes, steps

# --- placement ------------------------------------------------------------------------------------------------------


def _hex(position):
    return F.lower(F.lpad(F.hex(position), 16, "0"))


@registered(oracle.positions("SELECT o_custkey AS k FROM orders") + f"\nSELECT k AS o_custkey, lpad(lower(to_hex(id)), 16, '0') AS keyspace_id, {oracle.shard_case(SHARDS)} AS shard FROM placed")
def place_int(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return placement.place(keys, "o_custkey", "int", SHARDS, "at").select("o_custkey", _hex(F.col("at")).alias("keyspace_id"), "shard")


@registered(oracle.positions("SELECT o_custkey AS k FROM orders") + f"\nSELECT {oracle.shard_case(SHARDS)} AS shard, count(*) AS n FROM orders JOIN placed ON o_custkey = k GROUP BY 1")
def shard_histogram(spark, sf_dir):
    return placement.shard_counts(table(spark, sf_dir, "orders"), "o_custkey", "int", SHARDS)


_NUMERALS = "CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN '  -' || c_custkey || ' ' WHEN 2 THEN c_custkey || '.5' WHEN 3 THEN '1e' || (c_custkey % 9) WHEN 4 THEN '+' || c_custkey ELSE 'abc' END"


@registered(f"WITH t AS (SELECT c_custkey, {_NUMERALS} AS t FROM customer) SELECT c_custkey, CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN TRY_CAST(trim(t) AS BIGINT) END AS value FROM t")
def coerce_int_text(spark, sf_dir):
    text = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_NUMERALS.replace("VARCHAR", "STRING")).alias("t"))
    return text.select("c_custkey", K.coerce_column("int", F.col("t")).alias("value"))


@registered(
    "SELECT n_nationkey + 1 AS n, CAST(i AS INTEGER) AS part, CAST((i::UHUGEINT * 18446744073709551616::UHUGEINT) // (n_nationkey + 1)::UHUGEINT AS VARCHAR) AS bound "
    "FROM nation, LATERAL (SELECT unnest(range(0, n_nationkey + 1)) AS i)"
)
def split_even_n(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("n"))
    return placement.split_evenly(n, "n").select("n", F.col("part").cast("int").alias("part"), F.col("bound").cast("string").alias("bound"))


# ranges of each region's nations: sound in some, with a gap or an overlap in others
_RANGES = (
    "SELECT n_regionkey AS region, n_name AS name, CASE n WHEN 1 THEN CASE WHEN n_regionkey = 3 THEN '10' ELSE '' END ELSE substr('0033669980c0d0e0f0', 2 * n - 1, 2) END AS \"start\", "
    "CASE WHEN n = m THEN CASE WHEN n_regionkey = 4 THEN 'ff' ELSE '' END WHEN n_regionkey = 1 AND n = 2 THEN '60' WHEN n_regionkey = 2 AND n = 2 THEN '70' ELSE substr('0033669980c0d0e0f0', 2 * n + 1, 2) END AS \"end\" "
    "FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation)"
)


@registered(
    f"WITH r AS ({_RANGES}), b AS (SELECT region, name, rpad(\"start\", 16, '0') AS lo, CASE WHEN \"end\" = '' THEN 'g' ELSE rpad(\"end\", 16, '0') END AS hi FROM r), "
    "w AS (SELECT *, lag(hi) OVER (PARTITION BY region ORDER BY lo, name) AS b4, lead(lo) OVER (PARTITION BY region ORDER BY lo, name) AS nx FROM b) "
    "SELECT region, name, 'not-from-zero' AS fault FROM w WHERE b4 IS NULL AND lo <> repeat('0', 16) UNION ALL SELECT region, name, 'gap' FROM w WHERE b4 < lo "
    "UNION ALL SELECT region, name, 'overlap' FROM w WHERE b4 > lo UNION ALL SELECT region, name, 'not-to-end' FROM w WHERE nx IS NULL AND hi <> 'g'"
)
def validate_partition(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return placement.partition_faults(spark.sql(_RANGES.replace('"', "`")), ["region"])


@registered(f"WITH r AS ({_RANGES}), b AS (SELECT region, name, rpad(\"start\", 16, '0') AS lo, CASE WHEN \"end\" = '' THEN 'g' ELSE rpad(\"end\", 16, '0') END AS hi FROM r) SELECT a.region, a.name AS a_name, b.name AS b_name FROM b a JOIN b b ON a.region = b.region AND a.lo < b.hi AND b.lo < a.hi")
def range_overlaps(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    r = spark.sql(_RANGES.replace('"', "`"))
    return placement.overlaps(r, r, ["region"])


@registered("SELECT o_orderkey, printf('%X/%X', (o_orderkey * 1000003) // 4294967296, (o_orderkey * 1000003) % 4294967296) AS text, CAST(o_orderkey * 1000003 AS VARCHAR) AS back FROM orders")
def lsn_round_trip(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 1000003).alias("n"))
    text = n.withColumn("text", topology.lsn_text(F.col("n")))
    return text.select("o_orderkey", "text", topology.lsn(F.col("text")).cast("string").alias("back"))


# --- routed reads ---------------------------------------------------------------------------------------------------

_SINGLE = "SELECT * FROM orders WHERE o_custkey = 42"
_IN = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (1, 7, 42, 99)"
_AND = "SELECT o_orderkey, o_orderstatus FROM orders o WHERE o.o_custkey = '7' AND (o_orderstatus = 'F' AND o_totalprice > 1000)"
_FILTER = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000"


@registered(_SINGLE)
def read_single_shard(spark, sf_dir):
    return engine(spark, sf_dir).sql(_SINGLE, STRICT)


@registered(_IN)
def read_in_list(spark, sf_dir):
    return engine(spark, sf_dir).sql(_IN, STRICT)


@registered(_AND)
def read_and_chain(spark, sf_dir):
    return engine(spark, sf_dir).sql(_AND, STRICT)


@registered(_FILTER)
def read_scatter_filter(spark, sf_dir):
    return engine(spark, sf_dir).sql(_FILTER, STRICT)


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (3, 5)")
def read_bound_parameters(spark, sf_dir):
    return engine(spark, sf_dir).sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN ($1, $2)", STRICT, [3, "5"])


@registered(oracle.positions("SELECT o_custkey AS k FROM orders") + f"\nSELECT o_orderkey, o_custkey, o_orderstatus FROM orders JOIN placed ON o_custkey = k WHERE {oracle.shard_case(SHARDS)} = '40-80'")
def read_stored_shard(spark, sf_dir):
    """A table written by shard, of which one shard's folder is read."""
    store = Store(spark, scratch(spark, "store"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    store.create("public.orders", rows.schema, SCHEMA[TableName("public", "orders")])
    store.append("public.orders", rows, SHARDS)
    return store.read("public.orders", ["40-80"])


# --- ordered merges -------------------------------------------------------------------------------------------------


def _ranked(df: DataFrame, keys: list[SortKey], ties: list[str]) -> DataFrame:
    return number_rows(df, [*[order(F.col(k.column), k) for k in keys], *ties], 1, "rank")


@registered("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey NULLS LAST, o_orderkey) AS rank FROM orders")
def ordered_merge_int(spark, sf_dir):
    return _ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [SortKey("o_custkey")], ["o_orderkey"])


_ODD_FLOATS = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END"


@registered(f"WITH e AS (SELECT event_id, {_ODD_FLOATS} AS v FROM events) SELECT event_id, row_number() OVER (ORDER BY v ASC NULLS FIRST, event_id) AS rank FROM e")
def ordered_merge_float_nulls(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_ODD_FLOATS).alias("v"))
    return _ranked(e, [SortKey("v", nulls_first=True)], ["event_id"]).select("event_id", "rank")


@registered(f"WITH e AS (SELECT event_id, {_ODD_FLOATS} AS v FROM events) SELECT event_id, row_number() OVER (ORDER BY v DESC NULLS FIRST, event_id) AS rank FROM e")
def ordered_merge_desc(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_ODD_FLOATS).alias("v"))
    return _ranked(e, [SortKey("v", descending=True, nulls_first=True)], ["event_id"]).select("event_id", "rank")


@registered("SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0")
def ordered_scatter_parts(spark, sf_dir):
    """Shards as separate results, checked for agreement and merged."""
    e = engine(spark, sf_dir)
    parts = [(s, e.table("customer", [s]).filter("c_acctbal > 0").select("c_custkey", "c_nationkey")) for s in SHARDS.all()]
    return merge(parts, [SortKey("c_nationkey", descending=True, nulls_first=True), SortKey(1)])


# --- native SQL over all shards -------------------------------------------------------------------------------------

NATIVE_SQL = {
    "native_join_colocated": "SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 450000",
    "native_join_global": "SELECT n.n_name, count(*) AS n, CAST(sum(CAST(round(c.c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name",
    "native_left_join": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'",
    "native_full_join": "SELECT s.s_suppkey, p.p_partkey FROM supplier s FULL OUTER JOIN part p ON s.s_suppkey = p.p_partkey - 50",
    "native_group_by": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1",
    "native_filter_aggregate": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
    "native_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "native_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "native_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "native_distinct": "SELECT DISTINCT o_custkey, o_orderstatus FROM orders",
    "native_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10",
    "native_union": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0",
    "native_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "native_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'",
    "native_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000",
    "native_intersect_all": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'",
    "native_except_all": "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey AS k FROM customer",
    "native_natural_join": "SELECT k, v, w FROM (SELECT n_regionkey AS k, n_name AS v FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS w FROM region) b",
    "native_cross_join": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "native_range_join": "SELECT e.event_id, count(*) AS n FROM events e JOIN events f ON e.user_id = f.user_id AND f.ts BETWEEN e.ts - INTERVAL '1' HOUR AND e.ts GROUP BY e.event_id",
    "native_window_rank": "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders",
    "native_window_running": "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "native_semi": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 480000)",
    "native_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 200000)",
    "native_in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    "native_scalar_subquery": "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c",
    "native_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), most AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big, most WHERE n = m",
    "native_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, count(*) AS nations FROM t JOIN nation ON n_nationkey < n GROUP BY n",
    "native_functions": "SELECT c_custkey, upper(c_name) AS u, substr(c_name, 1, 8) AS s, length(c_name) AS l, CAST(floor(abs(c_acctbal)) AS BIGINT) AS a, coalesce(nullif(c_nationkey, 0), -1) AS k, CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS side FROM customer",
}


def _native(name: str, text: str) -> None:
    def run(spark, sf_dir):
        return engine(spark, sf_dir).sql(text, NATIVE)

    run.__name__ = name
    registered(text)(run)


for _name, _text in NATIVE_SQL.items():
    _native(_name, _text)


@registered(
    "WITH e AS (SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k, [CAST(event_id % 7 AS INTEGER), CAST(user_id % 5 AS INTEGER), 3] AS a, event_type FROM events) "
    "SELECT event_id, k, list_sum(a) AS total, list_max(a) AS most, list_contains(a, 4) AS four, len(list_distinct(a)) AS different, array_to_string(list_sort(list_transform(a, lambda x: x * 2)), ',') AS doubled, k + a[1] AS mapped FROM e"
)
def native_nested_functions(spark, sf_dir):
    """JSON, arrays and maps, through the engine's native mode."""
    return engine(spark, sf_dir).sql(
        "SELECT event_id, k, CAST(aggregate(a, 0, (x, y) -> x + y) AS DECIMAL(38,0)) AS total, array_max(a) AS most, array_contains(a, 4) AS four, CAST(size(array_distinct(a)) AS BIGINT) AS different, array_join(sort_array(transform(a, x -> x * 2)), ',') AS doubled, element_at(map('k', k, 'other', 0), 'k') + a[0] AS mapped "
        "FROM (SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, array(CAST(event_id % 7 AS INT), CAST(user_id % 5 AS INT), 3) AS a FROM events) e",
        NATIVE,
    )


# --- sequences ------------------------------------------------------------------------------------------------------


@registered("SELECT o_orderkey, o_custkey, 999 + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def seq_inject(spark, sf_dir):
    """Ids for rows that lack them: one reserved block of just as many, dense in the order of the key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    store = Store(spark, scratch(spark, "sequences"))
    store.create_sequence("orders_id", 1000, start=1000)
    first, _ = store.reserve("orders_id", max(1, orders.count()))
    return number_rows(orders, ["o_orderkey"], first, "id")


# --- change streams -------------------------------------------------------------------------------------------------


def change_log(events: DataFrame) -> DataFrame:
    """A change log made of events: of each user's events in turn an insert, an update that keeps its type, an update, a delete."""
    from pyspark.sql import Window as W

    e = events.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    op = F.element_at(F.array(F.lit("delete"), F.lit("insert"), F.lit("update"), F.lit("update")), (F.col("r") % 4 + 1).cast("int"))
    cell = lambda name, kind, value: F.struct(F.lit(name).alias("name"), kind.alias("kind"), value.alias("value"))
    text = F.lit("text")
    kind = F.when(F.col("r") % 4 == 2, "unchanged").otherwise("text")
    cells = F.array(cell("user_id", text, F.col("user_id").cast("string")), cell("event_id", text, F.col("event_id").cast("string")), cell("event_type", kind, F.when(kind == "text", F.col("event_type"))))
    key = F.array(F.col("user_id").cast("string"))
    return e.select(
        F.lit("s0").alias("shard"), F.col("event_id").alias("seq"), F.col("event_id").alias("commit_lsn"), F.col("event_id").alias("end_lsn"), op.alias("op"), F.lit("public").alias("schema"), F.lit("last_event").alias("table"),
        F.when(op != "delete", key).alias("key"), F.when(op != "insert", key).alias("old_key"), F.when(op != "delete", cells).alias("cells"), F.when(op == "delete", cells).alias("was"),
    )


_NET = (
    "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b4, count(*) OVER (PARTITION BY user_id) AS m FROM events) "
    "SELECT user_id, event_id, CASE WHEN r % 4 = 2 THEN b4 ELSE event_type END AS event_type FROM e WHERE r = m AND r % 4 <> 0"
)


@registered(_NET)
def cdc_net_change(spark, sf_dir):
    log = change_log(table(spark, sf_dir, "events"))
    none = spark.createDataFrame([], "key array<string>")
    net = net_changes(steps(log), none)
    value = lambda i: F.col("cells")[i]["value"]
    return net.filter("op = 'upsert'").select(value(0).cast("long").alias("user_id"), value(1).cast("long").alias("event_id"), value(2).alias("event_type"))


@registered(oracle.positions("SELECT user_id AS k FROM events") + f"\nSELECT event_id AS seq, user_id FROM events JOIN placed ON user_id = k WHERE id >= {1 << 63}::UBIGINT")
def cdc_range_filter(spark, sf_dir):
    log = change_log(table(spark, sf_dir, "events"))
    kept = keep_range(log, "user_id", "int", KeyRange(1 << 63))
    return kept.select("seq", F.coalesce("key", "old_key")[0].cast("long").alias("user_id"))


@registered(_NET)
def cdc_replay_idempotent(spark, sf_dir):
    """Applied in two batches to a stored table, the second sent with all of the first again, then everything once more."""
    events = table(spark, sf_dir, "events")
    log = change_log(events).cache()
    store = Store(spark, scratch(spark, "apply"))
    store.create("public.last_event", T._parse_datatype_string("user_id bigint, event_id bigint, event_type string"), TableDef("user_id", "int"))
    apply = Applier(store, "check", {"public.last_event": ["user_id"]}, SHARDS)
    half = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    apply.apply(log.filter(F.col("commit_lsn") <= half))
    apply.apply(log)
    apply.apply(log)
    log.unpersist()
    return store.read("public.last_event")


@registered(oracle.positions("SELECT c_custkey AS k FROM customer") + f"\nSELECT c_custkey, c_name, {oracle.shard_case(ShardCatalog.even(3))} AS target FROM customer JOIN placed ON c_custkey = k")
def range_copies(spark, sf_dir):
    """The rows that a copy to each of three ranges takes; together they are the source."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    parts = [placement.keep_range(rows, "c_custkey", "int", r).withColumn("target", F.lit(n)) for n, r in ShardCatalog.even(3).shards]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registered("SELECT * FROM customer")
def copy_text_round_trip(spark, sf_dir):
    """Rows written as copied text with their escapes, read back and typed."""
    rows = table(spark, sf_dir, "customer")
    path = scratch(spark, "copy")
    copytext.write(rows, path)
    return copytext.read(spark, path, rows.columns).select(*[copytext.typed(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema])


@registered("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, sf_dir):
    """Events as a stream, counted by hour and type under a watermark; the last state of each window."""
    path, cp = scratch(spark, "hours"), scratch(spark, "hours-checkpoint")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    counts = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type").count()

    def sink(batch: DataFrame, n: int) -> None:
        batch.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", F.col("count").alias("n")).write.mode("overwrite").parquet(f"{path}/{n}")

    query = counts.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", cp).trigger(availableNow=True).start()
    query.awaitTermination()
    # a complete batch has every window: the last one is the result
    return spark.read.parquet(f"{path}/{query.lastProgress['batchId']}")


def _streamed(spark, sf_dir, window, by: str) -> DataFrame:
    """Counts of events by windows, as a stream; each window once, when the watermark has passed its end."""
    path, cp = scratch(spark, "windows"), scratch(spark, "windows-checkpoint")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.withWatermark("ts", "1 hour").groupBy(window.alias("window"), by).count()
    out = counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), by, F.col("count").alias("n"))
    out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@registered(f"SELECT s AS start, s + INTERVAL 6 HOUR AS \"end\", event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS s FROM events) WHERE s + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY 1, 2, 3")
def stream_sliding_counts(spark, sf_dir):
    return _streamed(spark, sf_dir, F.window("ts", "6 hours", "3 hours"), "event_type")


@registered(
    "WITH w AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM w) "
    f"SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", user_id, count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 HOUR <= {_CLOSED}"
)
def stream_session_counts(spark, sf_dir):
    return _streamed(spark, sf_dir, F.session_window("ts", "2 hours"), "user_id")


# --- topology and time ----------------------------------------------------------------------------------------------


@registered("SELECT o_orderkey, (SELECT max(r_regionkey) + 1 FROM region WHERE TIMESTAMP '1994-01-01' + INTERVAL 1 YEAR * r_regionkey <= o_orderdate) AS generation FROM orders")
def topology_asof(spark, sf_dir):
    steps_ = table(spark, sf_dir, "region").select(F.expr("timestamp '1994-01-01' + make_ym_interval(r_regionkey, 0)").alias("valid_from"), (F.col("r_regionkey") + 1).alias("generation"))
    targets = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"))
    return temporal.topology_at(targets, steps_).select("o_orderkey", "generation")


@registered(
    "WITH b AS (SELECT 's' || (n_nationkey % 4) AS stanza, n_name AS label, TIMESTAMP '1993-01-01' + INTERVAL 1 DAY * (n_nationkey * 90) AS stop_time FROM nation), "
    "t AS (SELECT o_orderkey, 's' || (o_custkey % 5) AS stanza, o_orderdate AS t FROM orders) SELECT o_orderkey, label FROM t ASOF LEFT JOIN b ON t.stanza = b.stanza AND t.t >= b.stop_time"
)
def backup_asof(spark, sf_dir):
    backups = table(spark, sf_dir, "nation").select(F.expr("concat('s', n_nationkey % 4)").alias("stanza"), F.col("n_name").alias("label"), F.expr("timestamp '1993-01-01' + make_dt_interval(n_nationkey * 90)").alias("stop_time"))
    targets = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("concat('s', o_custkey % 5)").alias("stanza"), F.col("o_orderdate").alias("t"))
    return temporal.newest_backup_before(targets, backups).select("o_orderkey", "label")


def restore_catalog(spark, sf_dir) -> temporal.Catalog:
    """A cluster whose shards grow with each generation (a region): backups and barriers of each, with a shard a nation."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    g, k = F.col("r_regionkey") + 1, F.col("n_nationkey")
    since = F.expr("timestamp '2025-03-01' + make_dt_interval(r_regionkey * 10)")
    own = regions.join(nations, F.col("n_regionkey") <= F.col("r_regionkey"))
    name, stanza = F.concat(F.lit("n"), k), F.concat(F.lit("stanza-"), k)
    hashed = F.lit(K.HASH).alias("hash_function")
    data = F.collect_list(F.struct(name.alias("name"), stanza.alias("stanza"), F.lit("data").alias("role"), F.lit("Serving").alias("state")))
    system = F.array(F.struct(F.lit("sys").alias("name"), F.lit("stanza-sys").alias("stanza"), F.lit("system").alias("role"), F.lit("Serving").alias("state")))
    tables = F.array(F.struct(F.lit("public").alias("schema"), F.lit("t").alias("name"), F.lit("sharded").alias("type"), F.lit("k").alias("shard_key_column"), F.lit("int").alias("shard_key_type")))
    topologies = own.groupBy("r_regionkey").agg(F.concat(data, system).alias("shards")).select(g.alias("generation"), since.alias("valid_from"), F.lit(1).alias("epoch"), hashed, "shards", tables.alias("tables"))
    every = own.select("r_regionkey", k.cast("long").alias("i"), name.alias("name"), stanza.alias("stanza")).unionByName(regions.select("r_regionkey", F.lit(60).cast("long").alias("i"), F.lit("sys").alias("name"), F.lit("stanza-sys").alias("stanza")))
    done = F.expr("timestamp '2025-03-01' + make_dt_interval(r_regionkey * 10 + 4)")
    lsn = lambda base: F.concat(F.lit("0/"), F.hex(g * 4096 + base))
    backed = F.struct("name", "stanza", F.concat(F.lit("set-"), g, F.lit("-"), F.col("name")).alias("label"), lsn(F.col("i")).alias("stop_lsn"), F.lit(1).alias("timeline"), F.expr("timestamp '2025-03-01' + make_dt_interval(r_regionkey * 10 + 4, 0, -i)").alias("stop_time"))
    backups = every.groupBy("r_regionkey").agg(F.collect_list(backed).alias("shards")).select(F.concat(F.lit("bk"), g).alias("id"), done.alias("completed_at"), g.alias("topology_generation"), "shards")
    point = F.struct("name", "stanza", lsn(F.col("i") + 256).alias("lsn"), F.lit(1).alias("timeline"), F.concat(F.lit("point"), g).alias("restore_point"))
    barriers = every.groupBy("r_regionkey").agg(F.collect_list(point).alias("shards")).select(F.concat(F.lit("b"), g).alias("id"), F.expr("timestamp '2025-03-01' + make_dt_interval(r_regionkey * 10 + 7)").alias("time"), g.alias("topology_generation"), "shards")
    return temporal.Catalog(topologies, barriers, backups)


def _restored(generation: int, kind: str, value: str, exclusive: bool, timeline: str, verify: str) -> str:
    return (
        f"WITH s AS (SELECT n_nationkey AS i, 'n' || n_nationkey AS name, 'stanza-' || n_nationkey AS stanza FROM nation WHERE n_regionkey < {generation} UNION ALL SELECT 60, 'sys', 'stanza-sys') "
        f"SELECT name AS shard, stanza, 'set-{generation}-' || name AS \"set\", '{kind}' AS target_type, {value} AS target_value, {str(exclusive).lower()} AS target_exclusive, '{timeline}' AS target_timeline, CAST({verify} AS VARCHAR) AS verify_lsn FROM s"
    )


@registered(_restored(3, "time", "'2025-03-26T11:15:00Z'", False, "latest", "NULL"))
def restore_plan_time(spark, sf_dir):
    from datetime import datetime

    return temporal.resolve(restore_catalog(spark, sf_dir), time=datetime(2025, 3, 26, 11, 15))


@registered(_restored(2, "name", "'point2'", False, "1", "'0/' || to_hex(2 * 4096 + i + 256)"))
def restore_plan_barrier(spark, sf_dir):
    return temporal.resolve(restore_catalog(spark, sf_dir), barrier="b2")


@registered(_restored(4, "lsn", "'0/' || to_hex(4 * 4096 + i)", True, "1", "'0/' || to_hex(4 * 4096 + i)"))
def restore_plan_backup(spark, sf_dir):
    return temporal.resolve(restore_catalog(spark, sf_dir), backup="bk4")


@registered(_restored(5, "lsn", "'0/' || to_hex(5 * 4096 + i)", True, "1", "'0/' || to_hex(5 * 4096 + i)"))
def restore_plan_latest(spark, sf_dir):
    return temporal.resolve(restore_catalog(spark, sf_dir), latest=True)


@registered(
    "WITH w AS (SELECT user_id, event_id, event_type, CAST(floor(value / 20) AS BIGINT) AS v, lag(event_type) OVER o AS pt, lag(CAST(floor(value / 20) AS BIGINT)) OVER o AS pv, row_number() OVER o AS rn FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)), "
    "c AS (SELECT *, rn = 1 OR event_type IS DISTINCT FROM pt AS s, rn = 1 OR event_type IS DISTINCT FROM pt OR v IS DISTINCT FROM pv AS x FROM w), k AS (SELECT * FROM c WHERE x) "
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS generation FROM k"
)
def epoch_generation_fold(spark, sf_dir):
    views = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(F.col("value") / 20).cast("long").alias("v"))
    return topology.number_changes(views, ["event_type"], ["v"], "event_id", "user_id").select("user_id", "event_id", F.col("epoch").cast("long").alias("epoch"), F.col("generation").cast("long").alias("generation"))


@registered("WITH w AS (SELECT user_id, event_id, CAST(value AS BIGINT) AS epoch, max(CAST(value AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT user_id, event_id, floor(value) AS value FROM events)) SELECT user_id, event_id, epoch FROM w WHERE b IS NULL OR epoch > b")
def applied_epochs(spark, sf_dir):
    snapshots = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("epoch"))
    return topology.applied(snapshots, "event_id", "user_id")


@registered(
    "WITH t AS (SELECT o_custkey % 50 AS source, 1000 * max(o_orderkey) OVER (PARTITION BY o_custkey % 50) AS w, CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE o_orderkey * CASE WHEN o_custkey % 50 = 7 THEN 2000 ELSE 990 END END AS a FROM orders), "
    "g AS (SELECT source, max(w) AS w, min(a) AS lo, max(a) AS hi, count(*) FILTER (WHERE a IS NULL) AS u FROM t GROUP BY source) "
    "SELECT source, lo AS min_applied, CASE WHEN u = 0 AND hi <= w THEN w - lo END AS lag, coalesce(CASE WHEN u = 0 AND hi <= w THEN w - lo END <= 16777216, false) AS caught_up FROM g"
)
def catchup_lag(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("source", F.col("o_custkey") % 50)
    write = o.groupBy("source").agg((F.max("o_orderkey") * 1000).alias("write_lsn"))
    applied = F.when(F.col("o_orderkey") % 997 == 0, None).otherwise(F.col("o_orderkey") * F.when(F.col("source") == 7, 2000).otherwise(990))
    return election.catch_up(o.select("source", applied.alias("applied_lsn")).join(write, "source"))


# a shard for every five suppliers, in all sorts of states
_INSTANCES = (
    "SELECT s_suppkey // 5 AS shard, 'p' || s_suppkey AS pod, CASE WHEN s_suppkey % 23 = 3 THEN '' ELSE 'h' END AS host, s_suppkey % 3 <> 0 AS ready, s_suppkey % 25 = 1 AS is_primary, s_suppkey % 25 <> 1 AND s_suppkey % 31 <> 5 AS is_standby, "
    "CAST(s_suppkey % 4 AS DECIMAL(20,0)) AS received_lsn, s_suppkey % 41 = 9 AS wal_receiver, s_suppkey % 23 <> 3 AND s_suppkey % 37 <> 8 AS observed, CASE WHEN s_suppkey // 5 % 4 = 2 THEN 'p' || (s_suppkey // 5 * 5 + 1) END AS committed FROM supplier"
)


@registered(
    f"WITH i AS ({_INSTANCES}), g AS (SELECT shard, max(committed) AS c, bool_or(is_primary AND ready) AS hp, bool_or(is_primary) AS cl, bool_or(NOT observed AND host <> '') AS us, "
    "bool_or(observed AND NOT is_primary AND NOT is_standby AND pod IS DISTINCT FROM committed) AS un, bool_or(wal_receiver) AS wr, bool_or(coalesce(pod = committed, false) AND observed AND NOT is_primary) AS dr, "
    "max(received_lsn) FILTER (WHERE pod = committed AND observed AND NOT is_primary) AS tl, coalesce(max(received_lsn) FILTER (WHERE observed), 0) AS mx, count(*) FILTER (WHERE ready AND is_standby) AS nc FROM i GROUP BY shard), "
    "b AS (SELECT shard, pod, received_lsn AS l, row_number() OVER (PARTITION BY shard ORDER BY received_lsn DESC, pod) AS n FROM i WHERE ready AND is_standby), "
    "d AS (SELECT g.*, b.pod, b.l, hp OR (nc = 0 AND NOT dr AND c IS NULL) AS nothing, CASE WHEN c IS NOT NULL THEN NOT dr OR tl < mx ELSE l < mx END AS lags FROM g LEFT JOIN b ON g.shard = b.shard AND b.n = 1), "
    "f AS (SELECT *, NOT nothing AND (cl OR us OR un OR wr OR coalesce(lags, true)) AS w FROM d) SELECT shard, NOT nothing AS warranted, w AS wait, CASE WHEN NOT nothing AND NOT w THEN coalesce(c, pod) END AS target FROM f"
)
def failover_election(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return election.elect(spark.sql(_INSTANCES.replace("s_suppkey // 5", "s_suppkey div 5")))


@registered(
    "WITH c AS (SELECT 'public.' || lower(p_name) AS t, p_brand AS c FROM part UNION ALL SELECT 'public.' || lower(p_name), p_type FROM part), r AS (SELECT t, c, row_number() OVER (PARTITION BY t ORDER BY c) AS n, first_value(c) OVER (PARTITION BY t ORDER BY c) AS f FROM c) "
    "SELECT t AS \"table\", f AS first_config, c AS second_config FROM r WHERE n = 2"
)
def duplicate_tables(spark, sf_dir):
    """Tables that several configurations declare, under names of any case, in the default schema given or not."""
    p = table(spark, sf_dir, "part")
    one = p.select(F.col("p_brand").alias("config"), F.lit("").alias("schema"), F.col("p_name").alias("name"))
    two = p.select(F.col("p_type").alias("config"), F.lit("PUBLIC").alias("schema"), F.upper("p_name").alias("name"))
    return topology.duplicate_tables(one.unionByName(two))


# --- entry points ---------------------------------------------------------------------------------------------------


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(_SINGLE, STRICT)


def _all() -> None:
    """The rest of the registered queries, which use those of this module."""
    from keyspan import registry_control, registry_plans, registry_streams  # noqa: F401


def queries() -> dict:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(ORACLES)
