"""Compiling routing views, numbering their changes, and resharding decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyspan.functions.keyspace import KeyRange, KeyspaceError, format_bound, validate_partition
from keyspan.plans.catalog import HIDDEN, SERVING


class CompileError(ValueError):
    """Inputs that make no routing view."""


def primary_endpoints(shards: DataFrame, instances: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(shard, host, port) of shards (shard, current_primary) whose primary is there, ready and in that role."""
    ok = instances.filter(F.col("ready") & (F.col("role") == "primary")).select("shard", F.col("pod").alias("current_primary"))
    return shards.join(ok, ["shard", "current_primary"]).join(endpoints.withColumnRenamed("pod", "current_primary"), "current_primary").select("shard", "host", "port")


def replica_endpoints(shards: DataFrame, instances: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(shard, replicas): endpoints of the instances that are replicas and not the primary, by pod, each with can_read."""
    r = instances.filter(F.col("role") == "replica").join(shards.select("shard", "current_primary"), "shard").filter(~F.coalesce(F.col("pod") == F.col("current_primary"), F.lit(False))).join(endpoints, "pod")
    return r.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("pod", "host", "port", F.col("ready").alias("can_read")))).alias("replicas"))


def duplicate_tables(configs: DataFrame) -> DataFrame:
    """(table, first_config, second_config): tables (config, schema, name) that are declared twice, names without case.

    The configs are the first two by name, whatever order they come in.
    """
    name = F.lower(F.concat_ws(".", F.when(F.coalesce("schema", F.lit("")) == "", "public").otherwise(F.col("schema")), F.col("name")))
    by = W.partitionBy("table").orderBy("config")
    rows = configs.select(name.alias("table"), "config").withColumns({"n": F.row_number().over(by), "first_config": F.first("config").over(by)})
    return rows.filter("n = 2").select("table", "first_config", F.col("config").alias("second_config"))


def compile_view(cluster: str, lease: int | None, hash_function: str, shards: DataFrame, instances: DataFrame, endpoints: DataFrame, tables: DataFrame, gates: Sequence[str] = ()) -> DataFrame:
    """One row: the routing view in canonical order, whatever order its inputs come in.

    shards: (shard, start, end, role, serving, current_primary); tables: (config, schema, name, type, key, key_type).
    """
    if len(set(gates)) < len(gates):
        raise CompileError("two gates of one id")
    if shards.filter(F.col("role") == "system").count() > 1:
        raise CompileError("more than one system shard")
    if (twice := duplicate_tables(tables).orderBy("table").first()) is not None:
        raise CompileError(f"table {twice['table']} is in {twice['first_config']} and {twice['second_config']}")
    data = shards.filter(F.col("role") != "system")
    serving = [KeyRange.parse(f"{s['start']}-{s['end']}") for s in data.filter("serving").collect()]
    try:
        validate_partition(serving)
    except KeyspaceError as error:
        raise CompileError(f"serving shards: {error}") from error
    primary = primary_endpoints(shards, instances, endpoints).select("shard", F.struct("host", "port").alias("primary"))
    data = data.join(primary, "shard", "left").join(replica_endpoints(shards, instances, endpoints), "shard", "left")
    state = F.when(F.col("serving"), SERVING).otherwise(HIDDEN)
    entry = F.struct("start", "end", F.col("shard").alias("name"), state.alias("state"), "primary", F.coalesce("replicas", F.array().cast("array<struct<pod:string,host:string,port:int,can_read:boolean>>")).alias("replicas"))
    listed = data.agg(F.array_sort(F.collect_list(entry)).alias("shards"))
    schema = F.when(F.coalesce("schema", F.lit("")) == "", "public").otherwise(F.col("schema"))
    known = tables.agg(F.array_sort(F.collect_list(F.struct(schema.alias("schema"), "name", "type", "key", "key_type"))).alias("tables"))
    system = primary_endpoints(shards.filter(F.col("role") == "system"), instances, endpoints).agg(F.first(F.struct("host", "port")).alias("sequence_endpoint"))
    head = F.lit(cluster).alias("cluster"), F.lit(lease or 10).alias("write_lease_seconds"), F.lit(hash_function).alias("hash_function"), F.lit(sorted(gates)).cast("array<string>").alias("gates")
    # three aggregates, each of one row
    return listed.crossJoin(known).crossJoin(system).select(*head, "*")


def number_changes(views: DataFrame, structural: Sequence[str], other: Sequence[str], order: str = "at", within: str = "cluster") -> DataFrame:
    """views with `epoch` and `generation`, kept only where something changed.

    The epoch grows with any change, the generation with a change of the structural columns; both start at 1. A view like
    the one before it is no change.
    """
    by = W.partitionBy(within).orderBy(order)
    differs = lambda cs: F.exists(F.array(*[~F.col(c).eqNullSafe(F.lag(c).over(by)) for c in cs]), lambda x: x)
    rows = views.withColumns({"__first": F.row_number().over(by) == 1, "__s": differs(structural), "__o": differs(other) if other else F.lit(False)})
    rows = rows.filter("__first or __s or __o")
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(upto)
    return rows.withColumns({"epoch": count(F.lit(True)), "generation": count(F.col("__first") | F.col("__s"))}).drop("__first", "__s", "__o")


def applied(snapshots: DataFrame, order: str = "at", within: str = "router") -> DataFrame:
    """Snapshots that a router takes: those with an epoch above all before."""
    before = F.max("epoch").over(W.partitionBy(within).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return snapshots.withColumn("__before", before).filter("__before is null or epoch > __before").drop("__before")


def check_split(source: KeyRange, targets: Sequence[KeyRange]) -> None:
    """Targets must be two or more and divide the source without gap or overlap."""
    if len(targets) < 2:
        raise KeyspaceError("a reshard has two targets or more")
    ordered = sorted(targets, key=lambda r: r.start)
    if ordered[0].start != source.start or ordered[-1].end != source.end:
        raise KeyspaceError(f"targets reach from {ordered[0].start:#x} to {ordered[-1].end}, the source is {source}")
    for a, b in zip(ordered, ordered[1:], strict=False):
        if a.stop != b.start:
            raise KeyspaceError(f"{a} and {b} don't meet")


def barrier_acknowledged(targets: DataFrame) -> DataFrame:
    """(reshard, acknowledged) from targets (reshard, journal_lsn, frozen_lsn): all have the barrier."""
    return targets.groupBy("reshard").agg(F.bool_and(F.coalesce(F.col("journal_lsn") >= F.col("frozen_lsn"), F.lit(False))).alias("acknowledged"))


def switched(view: DataFrame, roles: DataFrame) -> DataFrame:
    """(reshard, switched) for a view (shard, state) and roles (reshard, shard, is_source): targets serve, the source doesn't."""
    r = roles.join(view, "shard", "left")
    good = F.when(F.col("is_source"), F.coalesce(F.col("state") == HIDDEN, F.lit(True))).otherwise(F.coalesce(F.col("state") == SERVING, F.lit(False)))
    return r.groupBy("reshard").agg(F.bool_and(good).alias("switched"))


#: Phases of a reshard and what moves it on; anything else holds it.
_STEPS = {
    ("Pending", "validated"): "ProvisioningTargets", ("ProvisioningTargets", "provisioned"): "Seeding", ("Seeding", "seeded"): "CatchingUp", ("CatchingUp", "caught-up"): "ReadyToCutover",
    ("ReadyToCutover", "cutover"): "CuttingOver", ("CuttingOver", "committed"): "SwitchedForward", ("CuttingOver", "rolled-back"): "CatchingUp",
}


def reshard_phase(events: Sequence[str], start: str = "Pending") -> tuple[str, int]:
    """(phase, cutover attempts) after events in order; `invalid` before seeding fails it for good."""
    phase, attempts = start, 1
    for e in events:
        if e == "invalid" and phase in ("Pending", "ProvisioningTargets"):
            return "Failed", attempts
        attempts += (phase, e) == ("CuttingOver", "rolled-back")
        phase = _STEPS.get((phase, e), phase)
    return phase, attempts


def tables_differ(pinned: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with `side`."""
    return pinned.exceptAll(live).withColumn("side", F.lit("pinned")).unionByName(live.exceptAll(pinned).withColumn("side", F.lit("live")))


def desired_layout(shards: int, prefix: str) -> list[tuple[str, str, str, str]]:
    """(name, role, start, end) of a new cluster: an even split and the system shard."""
    parts = KeyRange().split_evenly(shards)

    return [(f"{prefix}-{i}", "data", format_bound(r.start), "" if r.end is None else format_bound(r.end)) for i, r in enumerate(parts)] + [(f"{prefix}-system", "system", "", "")]


def lsn(text: Column) -> Column:
    """The number of an LSN written X/X; null for anything else."""
    ok = text.rlike(r"\A[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}\z")
    half = lambda i: F.conv(F.split(text, "/")[i], 16, 10).cast("decimal(20,0)")
    return F.when(ok, (half(0) * (1 << 32) + half(1)).cast("decimal(20,0)"))


def lsn_text(number: Column) -> Column:
    whole = F.floor(number / (1 << 32)).cast("bigint")
    return F.concat(F.hex(whole), F.lit("/"), F.hex((number - whole * (1 << 32)).cast("bigint")))


def shard_nodes(shards: DataFrame) -> DataFrame:
    """shards (cluster, shard, placement, colocate_with) with node, and whether the cluster owns it.

    Shared: all shards of a cluster on one node, its own or that of the cluster it is colocated with. Else a node a shard.
    """
    host = F.coalesce("colocate_with", "cluster")
    shared = F.col("placement") == "shared"
    return shards.withColumns({"node": F.when(shared, F.concat(host, F.lit("-shared"))).otherwise(F.col("shard")), "owned": ~shared | F.col("colocate_with").isNull()})


def identifier(name: Column) -> Column:
    """A name of any object as part of a database identifier: what is no ASCII letter, digit or underscore becomes one."""
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
