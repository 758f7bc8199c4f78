"""Registered queries of the control plane: keys of all types, identity, status, topology, resharding state, gates, settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan import oracle
from keyspan.functions import keyspace as K
from keyspan.functions.keyspace import KeyRange
from keyspan.operators import control, election, instance_config, topology
from keyspan.operators.reshard import check_workflow
from keyspan.plans.catalog import Topology
from keyspan.registering import SCHEMA, SHARDS, registered, table
from keyspan.registry import _INSTANCES

# --- keys -------------------------------------------------------------------------------------------------------------

_HEX16 = "lpad(hex(c_custkey * 2654435761), 16, '0')"
_UUIDS = f"CASE c_custkey % 6 WHEN 0 THEN lower({_HEX16} || {_HEX16}) WHEN 1 THEN '{{' || {_HEX16} || '-' || {_HEX16} || '}}' WHEN 2 THEN '{{' || {_HEX16} || {_HEX16} WHEN 3 THEN substr({_HEX16}, 1, 8) || '-' || substr({_HEX16}, 9) || '-' || {_HEX16} WHEN 4 THEN {_HEX16} ELSE {_HEX16} || 'zz' || substr({_HEX16}, 3) END"


def _custom(spark, sf_dir, text: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(text.replace("{{", "{").replace("}}", "}")).alias("t"))


@registered(f"WITH t AS (SELECT c_custkey, {_UUIDS.replace('hex(', 'to_hex(')} AS t FROM customer), d AS (SELECT *, replace(regexp_replace(t, '^[{{]|[}}]$', '', 'g'), '-', '') AS d FROM t) SELECT c_custkey, CASE WHEN starts_with(t, '{{') = ends_with(t, '}}') AND regexp_full_match(d, '[0-9A-Fa-f]{{32}}') THEN upper(d) END AS bytes FROM d")
def coerce_uuid_text(spark, sf_dir):
    return _custom(spark, sf_dir, _UUIDS).select("c_custkey", F.hex(K.coerce_column("uuid", F.col("t"))).alias("bytes"))


_BYTEAS = f"CASE c_custkey % 4 WHEN 0 THEN '\\x' || lower({_HEX16}) WHEN 1 THEN '\\x' WHEN 2 THEN '\\x' || {_HEX16} || '1' ELSE {_HEX16} END"


@registered(f"WITH t AS (SELECT c_custkey, {_BYTEAS.replace('hex(', 'to_hex(')} AS t FROM customer) SELECT c_custkey, CASE WHEN regexp_full_match(t, '\\\\x([0-9A-Fa-f]{{2}})*') THEN upper(substr(t, 3)) END AS bytes FROM t")
def coerce_bytea_text(spark, sf_dir):
    return _custom(spark, sf_dir, _BYTEAS.replace("\\x", "\\\\x")).select("c_custkey", F.hex(K.coerce_column("bytea", F.col("t"))).alias("bytes"))


def _placed(kind: str, text: str):
    """Position and shard of keys given as text, whose canonical form is their 16 bytes."""

    def run(spark, sf_dir):
        at = K.text_id_column(kind, F.col("t"))
        rows = _custom(spark, sf_dir, text).select("c_custkey", at.alias("at"))
        return rows.select("c_custkey", F.lower(F.lpad(F.hex("at"), 16, "0")).alias("keyspace_id"), K.route_column(F.col("at"), SHARDS.shards).alias("shard"))

    return run


def _placed_sql(digits: str) -> str:
    return oracle.positions_of_hex(f"SELECT c_custkey AS k, upper({digits}) AS h FROM customer") + f"\nSELECT k AS c_custkey, lpad(lower(to_hex(id)), 16, '0') AS keyspace_id, {oracle.shard_case(SHARDS)} AS shard FROM placed"


_TWICE = f"({_HEX16} || {_HEX16})"
_TEXT16 = "(lpad(CAST(c_custkey AS VARCHAR), 16, 'k'))"
for _name, _kind, _spark_text, _digits in (
    ("place_uuid", "uuid", _TWICE, _TWICE.replace("hex(", "to_hex(")),
    ("place_bytea", "bytea", f"'\\\\x' || {_TWICE}", _TWICE.replace("hex(", "to_hex(")),
    ("place_text", "text", _TEXT16.replace("VARCHAR", "STRING"), f"hex(encode({_TEXT16}))"),
):
    _run = _placed(_kind, _spark_text)
    _run.__name__ = _name
    registered(_placed_sql(_digits))(_run)

_BOUNDS = "CASE s_suppkey % 5 WHEN 0 THEN lower(lpad(hex(s_suppkey), 2, '0')) WHEN 1 THEN lower(lpad(hex(s_suppkey), 2, '0')) || '00' WHEN 2 THEN lower(lpad(hex(s_suppkey), 3, '0')) WHEN 3 THEN 'zz' ELSE '' END"


@registered(f"WITH t AS (SELECT s_suppkey, {_BOUNDS.replace('hex(', 'to_hex(')} AS t FROM supplier), v AS (SELECT *, regexp_full_match(t, '([0-9a-f]{{2}}){{0,8}}') AS ok FROM t) SELECT s_suppkey, ok AS valid, ok AND NOT (t <> '' AND ends_with(t, '00')) AS canonical, CASE WHEN ok THEN rpad(t, 16, '0') END AS bits, CASE WHEN ok THEN regexp_replace(t, '(00)+$', '') END AS back FROM v")
def bound_spellings(spark, sf_dir):
    """Bounds as text: read, told apart from those not spelled the one canonical way, and written back."""
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_BOUNDS).alias("t")).withColumn("at", K.parse_bound_column(F.col("t")))
    back = K.format_bound_column(F.col("at"))
    return t.select("s_suppkey", F.col("at").isNotNull().alias("valid"), F.coalesce(back == F.col("t"), F.lit(False)).alias("canonical"), F.lower(F.lpad(F.hex("at"), 16, "0")).alias("bits"), back.alias("back"))


# --- identity and status ----------------------------------------------------------------------------------------------

_SEEN = _INSTANCES.replace("AS committed FROM", "AS committed, CAST(CASE WHEN s_suppkey % 19 = 4 THEN 0 WHEN s_suppkey % 29 = 6 THEN 9 ELSE 7 END AS DECIMAL(20,0)) AS system_id, 1 + s_suppkey % 7 // 6 AS timeline FROM")
_LATCHED = "SELECT DISTINCT s_suppkey // 5 AS shard, CAST(CASE s_suppkey // 5 % 3 WHEN 0 THEN 7 WHEN 1 THEN 0 ELSE 9 END AS DECIMAL(20,0)) AS latched_id, CASE WHEN s_suppkey // 5 % 3 = 1 THEN 0 ELSE 1 END AS latched_timeline, s_suppkey // 5 % 11 = 7 AS malformed, 'p' || (s_suppkey // 5 * 5 + 1) AS current FROM supplier"


def _views(spark, sf_dir, *texts: str) -> list[DataFrame]:
    for t in ("supplier", "nation"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return [spark.sql(t.replace("s_suppkey // 5", "s_suppkey div 5").replace("s_suppkey % 7 // 6", "s_suppkey % 7 div 6")) for t in texts]


@registered(
    f"WITH i AS ({_SEEN}), l AS ({_LATCHED}), g AS (SELECT shard, count(DISTINCT system_id) FILTER (WHERE observed AND system_id <> 0) AS lineages FROM i GROUP BY shard), "
    "v AS (SELECT i.shard, pod, CASE WHEN malformed THEN 'unverifiable' WHEN latched_id = 0 THEN CASE WHEN lineages > 1 THEN 'conflict' ELSE 'kept' END WHEN coalesce(pod = committed, false) AND (system_id = 0 OR system_id = latched_id) THEN 'kept' WHEN system_id <> 0 AND system_id <> latched_id THEN 'foreign' "
    "WHEN is_primary THEN CASE WHEN system_id = latched_id AND latched_timeline <> 0 AND timeline = latched_timeline THEN 'kept' ELSE 'claimant' END WHEN observed AND system_id = 0 OR latched_timeline <> 0 AND timeline > latched_timeline THEN 'blocked' ELSE 'kept' END AS verdict FROM i JOIN l USING (shard) JOIN g USING (shard)) "
    "SELECT *, bool_or(verdict IN ('unverifiable', 'conflict', 'claimant')) OVER (PARTITION BY shard) AS suppress_primary FROM v"
)
def identity_verdicts(spark, sf_dir):
    instances, latched = _views(spark, sf_dir, _SEEN, _LATCHED)
    return election.assess_identity(instances, latched.drop("current")).select("shard", "pod", "verdict", "suppress_primary")


@registered(
    f"WITH i AS ({_SEEN}), l AS ({_LATCHED}), v AS (SELECT i.*, latched_id, latched_timeline, coalesce(pod = committed, false) AS target, is_primary AND (pod = current OR coalesce(pod = committed, false)) AS trusted FROM i JOIN l USING (shard) WHERE observed AND system_id <> 0), "
    "s AS (SELECT shard, count(DISTINCT system_id) AS ids, min(system_id) FILTER (WHERE trusted) AS new_id FROM v GROUP BY shard), d AS (SELECT l.*, CASE WHEN latched_id = 0 THEN CASE WHEN ids = 1 THEN new_id END ELSE latched_id END AS id FROM l LEFT JOIN s USING (shard)), "
    "m AS (SELECT v.shard, max(timeline) AS t FROM v JOIN d USING (shard) WHERE trusted AND system_id = id AND (target OR d.latched_timeline = 0) GROUP BY v.shard) SELECT shard, id AS system_id, greatest(latched_timeline, coalesce(t, 0)) AS timeline FROM d LEFT JOIN m USING (shard)"
)
def identity_latches(spark, sf_dir):
    instances, latched = _views(spark, sf_dir, _SEEN, _LATCHED)
    return election.latch_identity(instances, latched.drop("malformed"))


_IDS = "CASE s_suppkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '18446744073709551615' WHEN 2 THEN '18446744073709551616' WHEN 3 THEN ' 7' WHEN 4 THEN '' || s_suppkey ELSE NULL END"


@registered(f"WITH t AS (SELECT s_suppkey, {_IDS} AS t FROM supplier) SELECT s_suppkey, CASE WHEN regexp_full_match(t, '[0-9]{{1,20}}') AND TRY_CAST(t AS UBIGINT) > 0 THEN t END AS id FROM t")
def latched_id_text(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_IDS).alias("t"))
    return t.select("s_suppkey", election.parse_latched("t").cast("string").alias("id"))


@registered("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS INTEGER) END AS n FROM supplier")
def pod_ordinals(spark, sf_dir):
    pods = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat('sh-', s_suppkey) WHEN 1 THEN concat('other-', s_suppkey) ELSE concat('sh-', s_suppkey, '-x') END").alias("pod"))
    return pods.select("s_suppkey", election.ordinal("pod", "sh").alias("n"))


_ROLES = "SELECT s_suppkey // 5 AS shard, 'db-' || (s_suppkey % 5) AS pod, s_suppkey % 7 <> 2 AND s_suppkey // 5 <> 6 AS ready, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 17 = 3 THEN 'primary' WHEN s_suppkey % 13 = 4 THEN NULL ELSE 'replica' END AS role FROM supplier"
_WANTED = "SELECT DISTINCT s_suppkey // 5 AS shard, 2 + s_suppkey // 5 % 2 AS replicas, s_suppkey // 5 % 4 <> 2 AS had_primary, 'db' AS prefix FROM supplier"
_STATUS = (
    f"WITH i AS ({_ROLES}), w AS ({_WANTED}), g AS (SELECT w.shard, any_value(replicas) AS r, any_value(had_primary) AS h, count(*) FILTER (WHERE role = 'primary') AS p, min(pod) FILTER (WHERE role = 'primary') AS pod, count(*) FILTER (WHERE ready AND role IS NOT NULL) AS up, "
    "count(*) FILTER (WHERE ready AND role IS NOT NULL AND CAST(substr(pod, 4) AS INTEGER) < replicas) AS wanted FROM w JOIN i USING (shard) GROUP BY w.shard), "
    "s AS (SELECT shard, CASE WHEN p = 1 THEN pod END AS \"primary\", CASE WHEN p > 1 THEN 'Degraded' WHEN wanted = r AND p = 1 THEN 'Ready' WHEN up = 0 AND NOT h THEN 'Provisioning' ELSE 'Degraded' END AS phase FROM g) "
)


@registered(_STATUS + "SELECT * FROM s")
def shard_phases(spark, sf_dir):
    return election.shard_status(*_views(spark, sf_dir, _ROLES, _WANTED))


@registered(_STATUS + "SELECT shard % 6 AS cluster, CASE WHEN count(*) FILTER (WHERE phase <> 'Ready') = 0 THEN 'Ready' WHEN count(*) FILTER (WHERE phase = 'Degraded') = 0 THEN 'Provisioning' ELSE 'Degraded' END AS phase FROM s GROUP BY 1")
def cluster_phases(spark, sf_dir):
    s = election.shard_status(*_views(spark, sf_dir, _ROLES, _WANTED))
    return election.cluster_phase(s.select((F.col("shard") % 6).alias("cluster"), "phase"))


# --- topology ---------------------------------------------------------------------------------------------------------

_ENDPOINTS = "SELECT 'db-' || s_suppkey AS pod, 'h' || s_suppkey AS host, CAST(5432 + s_suppkey % 3 AS INTEGER) AS port FROM supplier WHERE s_suppkey % 23 <> 3"
_PODS = "SELECT s_suppkey // 5 AS shard, 'db-' || s_suppkey AS pod, s_suppkey % 7 <> 2 AS ready, CASE WHEN s_suppkey % 5 = 0 THEN 'primary' ELSE 'replica' END AS role FROM supplier"
_PRIMARIES = "SELECT DISTINCT s_suppkey // 5 AS shard, CASE WHEN s_suppkey // 5 % 6 <> 4 THEN 'db-' || (s_suppkey // 5 * 5) END AS current_primary FROM supplier"


@registered(f"WITH e AS ({_ENDPOINTS}), i AS ({_PODS}), s AS ({_PRIMARIES}) SELECT s.shard, host, port FROM s JOIN i ON i.shard = s.shard AND i.pod = s.current_primary AND ready AND role = 'primary' JOIN e ON e.pod = i.pod")
def primary_endpoints(spark, sf_dir):
    endpoints, pods, shards = _views(spark, sf_dir, _ENDPOINTS, _PODS, _PRIMARIES)
    return topology.primary_endpoints(shards, pods, endpoints)


@registered(f"WITH e AS ({_ENDPOINTS}), i AS ({_PODS}), s AS ({_PRIMARIES}) SELECT s.shard, row_number() OVER (PARTITION BY s.shard ORDER BY i.pod) - 1 AS n, i.pod, host, port, ready AS can_read FROM s JOIN i ON i.shard = s.shard AND role = 'replica' AND i.pod IS DISTINCT FROM s.current_primary JOIN e ON e.pod = i.pod")
def replica_endpoints(spark, sf_dir):
    endpoints, pods, shards = _views(spark, sf_dir, _ENDPOINTS, _PODS, _PRIMARIES)
    return topology.replica_endpoints(shards, pods, endpoints).select("shard", F.posexplode("replicas").alias("n", "r")).select("shard", F.col("n").cast("long").alias("n"), "r.*")


@registered(
    "WITH n AS (SELECT n_nationkey AS i, count(*) OVER () AS m FROM nation) SELECT i, 'n-' || i AS name, CASE WHEN i % 5 = 4 THEN 'Hidden' ELSE 'Serving' END AS state, CASE WHEN i % 5 <> 4 AND i % 3 <> 1 THEN 'h' || i END AS host, 10 AS write_lease_seconds, "
    "(SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) AS tables, 'h-sys' AS sequence_host FROM n WHERE i < 5"
)
def compiled_view(spark, sf_dir):
    """The routing view of a cluster of four serving shards, one hidden and the system shard, from inputs in any order."""
    n = table(spark, sf_dir, "nation")
    parts = KeyRange().split_evenly(4)
    rows = [(f"n-{i}", K.format_bound(r.start), "" if r.end is None else K.format_bound(r.end), "data", True, f"p{i}") for i, r in enumerate(parts)]
    rows += [("n-4", "40", "60", "data", False, "p4"), ("n-sys", "", "", "system", True, "p-sys")]
    shards = spark.createDataFrame(rows[::-1], "shard string, start string, `end` string, role string, serving boolean, current_primary string")
    pods = n.filter("n_nationkey < 4").select(F.concat(F.lit("n-"), "n_nationkey").alias("shard"), F.concat(F.lit("p"), "n_nationkey").alias("pod"), (F.col("n_nationkey") % 3 != 1).alias("ready"), F.lit("primary").alias("role")).unionByName(spark.createDataFrame([("n-sys", "p-sys", True, "primary")], "shard string, pod string, ready boolean, role string"))
    ends = pods.select("pod", F.concat(F.lit("h"), F.substr("pod", F.lit(2))).alias("host"), F.lit(5432).alias("port"))
    tables = n.filter("n_nationkey % 2 = 0").select(F.lit("c").alias("config"), F.lit("").alias("schema"), F.lower("n_name").alias("name"), F.lit("global").alias("type"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("key_type"))
    view = topology.compile_view("c", None, K.HASH, shards, pods, ends, tables)
    one = view.select("write_lease_seconds", F.size("tables").cast("long").alias("tables"), F.col("sequence_endpoint.host").alias("sequence_host"), F.explode("shards").alias("s"))
    return one.select(F.substr("s.name", F.lit(3)).cast("int").alias("i"), "s.name", "s.state", F.col("s.primary.host").alias("host"), "write_lease_seconds", "tables", "sequence_host")


_FAULTS = ["", "epoch", "lease", "generation", "hash", "gap", "state", "bound", "type", "gates", "key", "twice"]


def _document(i: int, fault: str) -> dict:
    end = "c0" if fault == "gap" else "8000" if fault == "bound" else "80"
    shards = [{"name": "a", "keyRange": {"start": "", "end": "80" if fault == "gap" else end}, "state": "Serving"}, {"name": "b", "keyRange": {"start": "90" if fault == "gap" else end}, "state": "Lost" if fault == "state" else "Serving"}]
    if fault == "state":
        shards.append({"name": "c", "keyRange": {"start": "10", "end": "20"}, "state": "Lost"})
        shards[1]["state"] = "Serving"
    tables = [{"schema": "public", "name": "t", "type": "odd" if fault == "type" else "sharded", "shardKeyColumn": None if fault == "key" else "k", "shardKeyType": "int"}] * (2 if fault == "twice" else 1)
    return {"epoch": 0 if fault == "epoch" else i + 1, "topologyGeneration": 0 if fault == "generation" else 1, "writeLeaseSeconds": 61 if fault == "lease" else 60, "hashFunction": "md5" if fault == "hash" else K.HASH, "shards": shards, "tables": tables, "gates": [{"id": "g"}] if fault == "gates" else []}


@registered(f"WITH f(t, fault) AS (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(_FAULTS))}) SELECT s_suppkey, fault IN ('', 'gates', 'key', 'twice') AS valid, fault = '' AS routable FROM supplier JOIN f ON t = s_suppkey % {len(_FAULTS)}")
def topology_documents(spark, sf_dir):
    """Topology documents, sound and with one fault each, read from files and checked."""
    from keyspan.plans.catalog import TopologyError

    texts = F.array(*[F.lit(json.dumps(_document(0, x))) for x in _FAULTS])
    docs = table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(texts, (F.col("s_suppkey") % len(_FAULTS) + 1).cast("int")).alias("doc"))

    def check(batches):
        for batch in batches:
            valid, routable = [], []
            for text in batch["doc"]:
                ok = [False, False]
                try:
                    found = Topology.from_json(json.loads(text)).validate()
                    ok[0] = True
                    found.routable()
                    ok[1] = True
                except (TopologyError, K.KeyspaceError):
                    pass
                valid.append(ok[0])
                routable.append(ok[1])
            yield batch[["s_suppkey"]].assign(valid=valid, routable=routable)

    return docs.mapInPandas(check, "s_suppkey long, valid boolean, routable boolean")


@registered("SELECT o_custkey % 40 AS reshard, bool_and(o_orderkey % 500 <> 3 AND o_orderkey * 10 >= 1000 * (o_custkey % 40 % 2)) AS acknowledged FROM orders GROUP BY 1")
def barrier_acks(spark, sf_dir):
    """Whether every target of a reshard has the barrier; one without a journal position has not."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 40
    return topology.barrier_acknowledged(o.select(k.alias("reshard"), F.when(F.col("o_orderkey") % 500 != 3, F.col("o_orderkey") * 10).alias("journal_lsn"), (1000 * (k % 2)).alias("frozen_lsn")))


@registered("WITH r AS (SELECT s_suppkey % 20 AS reshard, s_suppkey < 20 AS is_source, CASE WHEN s_suppkey % 9 = 5 THEN NULL WHEN (s_suppkey < 20) = (s_suppkey % 11 <> 6) THEN 'Hidden' ELSE 'Serving' END AS state FROM supplier) SELECT reshard, bool_and(CASE WHEN is_source THEN coalesce(state = 'Hidden', true) ELSE coalesce(state = 'Serving', false) END) AS switched FROM r GROUP BY 1")
def switched_sets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("s"), "s_suppkey").alias("shard")
    state = F.when((F.col("s_suppkey") < 20) == (F.col("s_suppkey") % 11 != 6), "Hidden").otherwise("Serving").alias("state")
    roles = s.select((F.col("s_suppkey") % 20).alias("reshard"), name, (F.col("s_suppkey") < 20).alias("is_source"))
    return topology.switched(s.filter("s_suppkey % 9 <> 5").select(name, state), roles)


@registered("SELECT n_nationkey AS n, 'c-' || i AS name, 'data' AS role, CASE WHEN i = 0 THEN '' ELSE b END AS start, coalesce(lead(b) OVER (PARTITION BY n_nationkey ORDER BY i), '') AS \"end\" FROM (SELECT n_nationkey, i, " + oracle.bound_text("CAST((i::UHUGEINT * 18446744073709551616::UHUGEINT) // (n_nationkey + 1)::UHUGEINT AS UBIGINT)") + " AS b FROM nation, LATERAL (SELECT unnest(range(0, n_nationkey + 1)) AS i)) UNION ALL SELECT n_nationkey, 'c-system', 'system', '', '' FROM nation")
def initial_layouts(spark, sf_dir):
    """The layout of a new cluster of each size: an even split and the system shard."""
    sizes = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # one row a nation
    return spark.createDataFrame([(n, *row) for n in sizes for row in topology.desired_layout(n + 1, "c")], "n int, name string, role string, start string, `end` string")


_PHASES = ["Pending", "ProvisioningTargets", "Seeding", "CatchingUp", "ReadyToCutover", "CuttingOver", "CatchingUp", "ReadyToCutover", "CuttingOver", "SwitchedForward", "SwitchedForward"]
_MOVES = ["validated", "provisioned", "seeded", "caught-up", "cutover", "rolled-back", "caught-up", "cutover", "committed", "invalid"]


@registered(f"WITH p(i, phase) AS (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(_PHASES))}) SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 3 THEN 'Failed' ELSE phase END AS phase, CASE WHEN s_suppkey % 7 <> 3 AND i >= 6 THEN 2 ELSE 1 END AS attempts FROM supplier JOIN p ON i = s_suppkey % {len(_PHASES)}")
def reshard_phases(spark, sf_dir):
    """Each reshard after the first so many of its events, a failed validation and a rolled back cutover among them."""
    events = F.slice(F.array(*[F.lit(x) for x in _MOVES]), 1, (F.col("s_suppkey") % len(_PHASES)).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 3, F.concat(F.array(F.lit("unknown"), F.lit("invalid")), events)).otherwise(events).alias("events"))

    def fold(batches):
        for batch in batches:
            found = [topology.reshard_phase(list(e)) for e in batch["events"]]
            yield batch[["s_suppkey"]].assign(phase=[p for p, _ in found], attempts=[n for _, n in found])

    return rows.mapInPandas(fold, "s_suppkey long, phase string, attempts int")


@registered("SELECT p_partkey, p_brand, 'pinned' AS side FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'changed' ELSE 'new' END, 'live' FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 13 = 5 AND p_partkey % 7 <> 0")
def table_drift(spark, sf_dir):
    """Rows in which pinned table settings and live ones differ, either way."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    live = p.withColumn("p_brand", F.when(F.col("p_partkey") % 7 == 0, "changed").otherwise(F.col("p_brand")))
    return topology.tables_differ(p, live.unionByName(p.filter("p_partkey % 13 = 5 and p_partkey % 7 <> 0").withColumn("p_brand", F.lit("new"))))


_SPLITS = ["-20 20-40", "-40", "-20 30-40", "-30 20-40", "-20 20-60", "10-20 20-40", "-10 10-20 20-40"]


@registered(f"SELECT s_suppkey, s_suppkey % {len(_SPLITS)} IN (0, 6) AS sound FROM supplier")
def reshard_splits(spark, sf_dir):
    """Targets that divide shard -40, and such that don't: one alone, gap, overlap, beyond an end."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(*[F.lit(x) for x in _SPLITS]), (F.col("s_suppkey") % len(_SPLITS) + 1).cast("int")).alias("targets"))

    def check(batches):
        for batch in batches:
            sound = []
            for text in batch["targets"]:
                try:
                    topology.check_split(KeyRange.parse("-40"), [KeyRange.parse(r) for r in text.split()])
                    sound.append(True)
                except K.KeyspaceError:
                    sound.append(False)
            yield batch[["s_suppkey"]].assign(sound=sound)

    return rows.mapInPandas(check, "s_suppkey long, sound boolean")


@registered("SELECT * FROM (VALUES ('sound', true), ('no id', false), ('no tables', false), ('global table', false), ('another key', false), ('renamed', false), ('bad range', false)) v(what, ok)")
def workflow_specs(spark, sf_dir):
    """Specifications of copy-and-follow workflows, checked against the tables that are sharded."""
    known = {str(n): t for n, t in SCHEMA.items()}
    orders = {"name": "public.orders"}
    sound = {"id": "w", "range": "-40", "tables": [orders]}
    specs = {"sound": sound, "no id": {**sound, "id": ""}, "no tables": {**sound, "tables": []}, "global table": {**sound, "tables": [{"name": "public.nation"}]}, "another key": {**sound, "tables": [{**orders, "key": "o_orderkey"}]}, "renamed": {**sound, "tables": [{**orders, "target": "public.o"}]}, "bad range": {**sound, "range": "40"}}
    out = []
    for what, spec in specs.items():
        try:
            check_workflow(spec, known)
            out.append((what, True))
        except (RuntimeError, ValueError):
            out.append((what, False))
    return spark.createDataFrame(out, "what string, ok boolean")


# --- gates, epochs, leases --------------------------------------------------------------------------------------------


@registered(
    oracle.positions("SELECT o_custkey AS k FROM orders") + "\nSELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'writes to urgent' WHEN id >= 4611686018427387904::UBIGINT AND id < 9223372036854775808::UBIGINT THEN 'second quarter' WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'all writes' END AS gate FROM orders JOIN placed ON o_custkey = k"
)
def gate_matches(spark, sf_dir):
    """The first gate that holds each statement: by table, by a range of keys, or all writes."""
    o = table(spark, sf_dir, "orders")
    tables = F.array(F.lower("o_orderpriority"), F.lit("orders"))
    at = F.array(K.id_column("int", F.col("o_custkey")))
    rows = o.select("o_orderkey", tables.alias("tables"), at.alias("positions"), (F.col("o_orderstatus") == "F").alias("is_write"), (F.col("o_orderkey") % 10 == 0).alias("tenth"))
    named = [control.Gate("writes to urgent", 0, tables=("1-urgent",)), control.Gate("second quarter", 0, writes_only=False, ranges=(KeyRange.parse("40-80"),))]
    whole = control.Gate("all writes", 0, everything=True)
    return control.held_by(rows.filter("tenth"), [*named, whole]).unionByName(control.held_by(rows.filter("not tenth"), named)).select("o_orderkey", "gate")


@registered(
    "WITH g AS (SELECT n_nationkey AS gate, CASE WHEN n_nationkey % 4 <> 3 THEN 100.0 + n_nationkey END AS opened, 120.0 AS deadline, n_nationkey % 3 AS m FROM nation), r AS (SELECT *, CASE m WHEN 1 THEN 105.0 WHEN 2 THEN 118.0 END AS ready FROM g), "
    "e AS (SELECT gate, deadline, CASE WHEN opened IS NULL THEN NULL WHEN greatest(opened, coalesce(ready, opened)) < deadline THEN greatest(opened, coalesce(ready, opened)) END AS released FROM r), s AS (SELECT s_suppkey % 25 AS gate, s_suppkey AS session, 90.0 + s_suppkey % 37 AS since FROM supplier) "
    "SELECT gate, session, CAST(since AS DOUBLE) AS since, CASE WHEN since >= coalesce(released, deadline) THEN NULL WHEN coalesce(released, deadline) - since > 20 THEN 'rejected' WHEN released IS NOT NULL THEN 'replan' ELSE 'expired' END AS outcome FROM s JOIN e USING (gate)"
)
def gate_outcomes(spark, sf_dir):
    """What becomes of sessions parked at gates: planned anew, expired with their gate, or rejected for waiting too long."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    gates = n.select(k.cast("long").alias("gate"), F.when(k % 4 != 3, k + 100.0).alias("opened"), F.lit(120.0).alias("deadline"), (k % 3).alias("min_generation"))
    sessions = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 25).alias("gate"), F.col("s_suppkey").alias("session"), (F.col("s_suppkey") % 37 + 90.0).alias("since"))
    generations = spark.createDataFrame([(1, 105.0), (2, 118.0)], "generation int, at double")
    return control.gate_outcomes(sessions, gates, generations, 20.0)


@registered(
    "WITH d AS (SELECT user_id, event_id, CAST(floor(value / 3) AS BIGINT) - 1 AS epoch, event_type AS key FROM events), m AS (SELECT *, max(CASE WHEN epoch >= 1 THEN epoch * 1000000000 - event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM d), "
    "l AS (SELECT *, coalesce((top + 999999999) // 1000000000, 0) AS last FROM m) SELECT l.user_id, l.event_id, CASE WHEN l.epoch < 1 THEN 'invalid' WHEN l.epoch < last THEN 'stale' WHEN l.epoch > last THEN 'apply' WHEN l.key = f.key THEN 'replay' ELSE 'conflict' END AS verdict "
    "FROM l LEFT JOIN d f ON f.user_id = l.user_id AND f.event_id = last * 1000000000 - top"
)
def decision_epochs(spark, sf_dir):
    """Decisions that reach an agent out of order and more than once: applied once each, in the order of their epochs."""
    d = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor(F.col("value") / 3) - 1).cast("long").alias("epoch"), F.col("event_type").alias("key"))
    return control.judge_decisions(d, "user_id", "event_id").select("user_id", "event_id", "verdict")


@registered(
    "WITH c AS (SELECT event_id, CASE WHEN user_id % 50 = 0 THEN '' ELSE 'm' || user_id % 50 END AS id, CASE WHEN event_type = 'error' THEN 'b' ELSE 'a' END AS sql, value < 5 AS ok FROM events), f AS (SELECT *, first_value(sql) OVER (PARTITION BY id ORDER BY event_id) AS first FROM c), "
    "g AS (SELECT *, coalesce(bool_or(sql = first AND ok) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM f) SELECT event_id, CASE WHEN id = '' THEN 'invalid' WHEN sql <> first THEN 'conflict' WHEN done THEN 'replay' ELSE 'execute' END AS verdict FROM g"
)
def ddl_log(spark, sf_dir):
    """Schema statements claimed by id: run until one succeeds, then replayed; an id is bound to its first text."""
    e = table(spark, sf_dir, "events")
    claims = e.select("event_id", F.when(F.col("user_id") % 50 == 0, "").otherwise(F.concat(F.lit("m"), F.col("user_id") % 50)).alias("id"), F.when(F.col("event_type") == "error", "b").otherwise("a").alias("sql"), (F.col("value") < 5).alias("ok"))
    return control.judge_statements(claims, "event_id").select("event_id", "verdict")


@registered(
    "WITH p AS (SELECT user_id, event_id, event_id * 1.0 AS boot, event_id + CASE WHEN event_id % 97 = 5 THEN 9.0 ELSE 0.0 END AS wall, event_type = 'click' AS ok FROM events), "
    "l AS (SELECT *, last_value(CASE WHEN ok THEN boot END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN ok THEN wall END IGNORE NULLS) OVER w AS c FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
    "SELECT event_id, CAST(CASE WHEN boot >= b THEN greatest(boot - b, wall - c) END AS DOUBLE) AS age, coalesce(boot >= b AND greatest(boot - b, wall - c) < 300, false) AS may_write FROM l"
)
def lease_freshness(spark, sf_dir):
    """The age of each router's last confirmation by two clocks, and whether it may still write."""
    e = table(spark, sf_dir, "events")
    polls = e.select("user_id", "event_id", F.col("event_id").cast("double").alias("boot"), (F.col("event_id") + F.when(F.col("event_id") % 97 == 5, 9.0).otherwise(0.0)).alias("wall"), (F.col("event_type") == "click").alias("confirmed"))
    return control.freshness(polls, "user_id", "event_id", 300.0).select("event_id", "age", "may_write")


@registered("WITH v AS (SELECT o_custkey % 30 * 143165576 AS base, o_orderkey * 2654435761 % 4294967296 AS version FROM orders) SELECT base, arg_min(version, (version - base + 4294967296) % 4294967296) AS horizon FROM v GROUP BY base")
def xid_horizons(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 30 * 143165576).alias("base"), (F.col("o_orderkey") * 2654435761 % 4294967296).alias("version"))
    return control.xid_horizons(v)


# --- instance settings ------------------------------------------------------------------------------------------------

_MB = "1048576"
_SIZED = (
    f"WITH s AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' ELSE 'XL' END AS size, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey + 1) * 700 * {_MB} END AS memory, CASE WHEN s_suppkey % 5 = 2 THEN s_suppkey END AS cores, CASE WHEN s_suppkey % 6 = 1 THEN 50 + s_suppkey END AS connections, s_suppkey % 2 * 4 AS headroom FROM supplier), "
    "c(size, cores, gib, replicas, connections) AS (VALUES ('S', 1, 4, 2, 100), ('M', 4, 16, 3, 200), ('L', 8, 64, 3, 300), ('XL', 16, 128, 5, 400)), "
    f"d AS (SELECT id, replicas, headroom, coalesce(s.memory, gib::BIGINT * 1024 * {_MB}) AS m, coalesce(s.cores, c.cores) AS n, coalesce(s.connections, c.connections) AS k, s.connections AS asked FROM s JOIN c USING (size)) "
)


@registered(
    _SIZED + f"SELECT id, replicas, least(m // 4, 32768::BIGINT * {_MB}) // {_MB} || 'MB' AS shared_buffers, m * 70 // 100 // {_MB} || 'MB' AS effective_cache_size, least(m // 16, 2048::BIGINT * {_MB}) // {_MB} || 'MB' AS maintenance_work_mem, greatest(m // 4 // k, 4 * {_MB}) // {_MB} || 'MB' AS work_mem, "
    "CASE WHEN asked IS NULL THEN CAST(k AS VARCHAR) ELSE '''' || asked || '''' END AS max_connections, CAST(greatest(n, 8) AS VARCHAR) AS max_worker_processes, CAST(least(greatest(n // 2, 3), 32) AS VARCHAR) AS io_workers, CAST(replicas + headroom AS VARCHAR) AS max_wal_senders, 23 AS settings, 64 AS hash FROM d"
)
def instance_settings(spark, sf_dir):
    """Settings of instances of every size class, with memory, cores and connections of their own."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rows = s.select(k.alias("id"), F.element_at(F.array(*[F.lit(x) for x in ("S", "M", "L", "XL")]), (k % 4 + 1).cast("int")).alias("size"), F.when(k % 3 == 0, (k + 1) * 700 * (1 << 20)).alias("memory"), F.when(k % 5 == 2, k).alias("cores"), F.when(k % 6 == 1, k + 50).alias("connections"), (k % 2 * 4).alias("headroom"))
    out = instance_config.render_rows(rows)
    return out.withColumns({"settings": F.size(F.split("settings", ",")), "hash": F.length("hash")})




@registered("SELECT s_suppkey, sha256('3:cpu' || length(CAST(s_suppkey AS VARCHAR)) || ':' || s_suppkey || '6:memory' || '2:64' || '1:a' || '0:' || '8:work_mem' || length(s_name) || ':' || s_name) AS hash FROM supplier")
def settings_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    def run(batches):
        for batch in batches:
            yield batch[["s_suppkey"]].assign(hash=[instance_config.config_hash({"work_mem": n, "a": ""}, int(k), 64) for k, n in zip(batch["s_suppkey"], batch["s_name"], strict=True)])

    return rows.mapInPandas(run, "s_suppkey long, hash string")


_GIVEN = [(" Work_Mem ", "work_mem"), ("archive_command", ""), ("a b", ""), ("my.setting", "my.setting"), ("INCLUDE_DIR", ""), ("x\ny", ""), ("max_connections", "max_connections")]


@registered(f"WITH g(t, name) AS (VALUES {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, (_, n) in enumerate(_GIVEN))}) SELECT s_suppkey, CASE WHEN name <> '' AND s_suppkey % 11 <> 4 THEN name END AS name, CASE WHEN name = '' OR s_suppkey % 11 = 4 THEN 'refused' WHEN name = 'work_mem' THEN 'reload' ELSE 'restart' END AS applied FROM supplier JOIN g ON t = s_suppkey % {len(_GIVEN)}")
def user_settings(spark, sf_dir):
    """Settings that users give: under their normal names, or refused; and whether a change of them takes a restart."""
    name = F.element_at(F.array(*[F.lit(n) for n, _ in _GIVEN]), (F.col("s_suppkey") % len(_GIVEN) + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("given"), F.when(F.col("s_suppkey") % 11 == 4, "1\n2").otherwise("1").alias("value"))

    def run(batches):
        for batch in batches:
            names, applied = [], []
            for given, value in zip(batch["given"], batch["value"], strict=True):
                try:
                    clean = instance_config.clean_settings({given: value})
                except instance_config.ConfigError:
                    names.append(None)
                    applied.append("refused")
                    continue
                reload, _ = instance_config.changes({}, clean)
                names.append(next(iter(clean)))
                applied.append("reload" if reload else "restart")
            yield batch[["s_suppkey"]].assign(name=names, applied=applied)

    return rows.mapInPandas(run, "s_suppkey long, name string, applied string")


# --- more of status and layout ----------------------------------------------------------------------------------------


@registered("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'primary' ELSE 'standby' END AS role, s_suppkey % 5 <> 1 AND s_suppkey % 7 <> 2 AS ready FROM supplier")
def instance_status(spark, sf_dir):
    polls = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3 != 0).alias("in_recovery"), (F.col("s_suppkey") % 5 != 1).alias("accepting"), (F.col("s_suppkey") % 7 == 2).alias("fenced"))
    return election.observed_status(polls).select("s_suppkey", "role", "ready")


@registered(_STATUS + "SELECT shard, CASE WHEN shard % 7 = 3 THEN 'FailingOver' WHEN shard % 7 = 5 THEN 'Provisioning' ELSE phase END AS phase FROM s")
def node_phases(spark, sf_dir):
    """Phases of shards, each on a node of its own, from their nodes' phases: failing over is passed on, an unknown phase is none."""
    s = election.shard_status(*_views(spark, sf_dir, _ROLES, _WANTED))
    nodes = s.withColumn("phase", F.when(F.col("shard") % 7 == 3, "FailingOver").when(F.col("shard") % 7 == 5, "Bootstrapping").otherwise(F.col("phase")))
    return nodes.select("shard", election.phase_of_shard().alias("phase"))


@registered(
    f"WITH i AS ({_SEEN}), l AS ({_LATCHED}), g AS (SELECT shard, count(DISTINCT system_id) FILTER (WHERE observed AND system_id <> 0) AS lineages FROM i GROUP BY shard), "
    "v AS (SELECT i.shard, pod, host, observed, latched_id, malformed, NOT malformed AND latched_id = 0 AND lineages > 1 AS conflict, NOT malformed AND latched_id <> 0 AND (system_id <> 0 AND system_id <> latched_id "
    "OR is_primary AND NOT coalesce(pod = committed, false) AND NOT (system_id = latched_id AND latched_timeline <> 0 AND timeline = latched_timeline)) AS fenced FROM i JOIN l USING (shard) JOIN g USING (shard)), "
    "s AS (SELECT shard, any_value(latched_id) <> 0 AS known, any_value(malformed) AS bad, bool_or(conflict) AS conflict, coalesce(string_agg(pod, ',' ORDER BY pod) FILTER (WHERE fenced OR conflict), '') AS pods, bool_or(NOT observed AND host <> '') AS unseen FROM v GROUP BY shard), "
    "r AS (SELECT *, CASE WHEN bad THEN 'MalformedIdentity' WHEN conflict THEN 'IdentityConflict' WHEN known AND pods <> '' THEN 'ForeignInstance' WHEN known AND unseen THEN 'IncompleteObservation' WHEN known THEN 'Latched' END AS reason FROM s) "
    "SELECT shard, CASE reason WHEN 'Latched' THEN 'True' WHEN 'IncompleteObservation' THEN 'Unknown' ELSE 'False' END AS status, reason, pods FROM r WHERE reason IS NOT NULL"
)
def identity_summaries(spark, sf_dir):
    instances, latched = _views(spark, sf_dir, _SEEN, _LATCHED)
    found = election.identity_summary(election.assess_identity(instances, latched.drop("current")), latched)
    return found.withColumn("pods", F.array_join("pods", ","))


@registered("SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN CASE WHEN s_nationkey % 2 = 0 THEN 'c1' ELSE 'c' || s_nationkey END || '-shared' ELSE s_name END AS node, s_nationkey % 3 <> 0 OR s_nationkey % 2 <> 0 AS owned FROM supplier")
def shard_nodes(spark, sf_dir):
    n = F.col("s_nationkey")
    shards = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("c"), n).alias("cluster"), F.col("s_name").alias("shard"), F.when(n % 3 == 0, "shared").otherwise("dedicatedInstance").alias("placement"), F.when((n % 3 == 0) & (n % 2 == 0), "c1").alias("colocate_with"))
    return topology.shard_nodes(shards).select("s_suppkey", "node", "owned")


@registered("SELECT p_partkey, regexp_replace(p_name || '-' || p_brand || '.é', '[^A-Za-z0-9_]', '_', 'g') AS identifier FROM part")
def seed_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", topology.identifier(F.concat("p_name", F.lit("-"), "p_brand", F.lit(".é"))).alias("identifier"))
