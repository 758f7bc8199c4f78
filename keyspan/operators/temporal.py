"""As-of lookups over topology snapshots and backups, and restore plans.

A catalog is three tables: topologies (generation, valid_from, epoch, hash_function, shards, tables), barriers (id, time,
topology_generation, routing_epoch, shards) and backups (id, completed_at, topology_generation, routing_epoch, shards),
where shards and tables are arrays of structs. Lookups are written for many targets at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.functions.keyspace import HASH, KEY_TYPES
from keyspan.operators.running import last_value
from keyspan.plans.catalog import STATES

#: What a plan consists of, one row for each shard.
PLAN_COLUMNS = ["shard", "stanza", "set", "target_type", "target_value", "target_exclusive", "target_timeline", "verify_lsn"]


class RestoreError(ValueError):
    """A target that can't be restored, and why."""


@dataclass(frozen=True)
class Catalog:
    topologies: DataFrame
    barriers: DataFrame
    backups: DataFrame


#: Versions of one history that are sent along with targets; longer histories are merged with them by time.
FEW = 1000


def _merged(targets: DataFrame, versions: DataFrame, within: list[str], time: str, at: str, value: Column, name: str, rank: list[str]) -> DataFrame:
    """targets with the last value at or before their time, among versions (*within, at, *rank): both in one order, in many tasks."""
    none = F.lit(None)
    mine = targets.withColumns({"__at": F.col(time), "__row": F.struct(*targets.columns), "__value": none.cast(versions.select(value).schema[0].dataType), "__late": F.lit(1), "__n": F.monotonically_increasing_id()})
    theirs = versions.withColumns({"__at": F.col(at), "__row": none.cast(mine.schema["__row"].dataType), "__value": value, "__late": F.lit(0), "__n": F.lit(0).cast("long"), **{f"__r{i}": F.col(r) for i, r in enumerate(rank)}})
    mine = mine.withColumns({f"__r{i}": none.cast(versions.schema[r].dataType) for i, r in enumerate(rank)})
    order = ["__at", "__late", *[f"__r{i}" for i in range(len(rank))], "__n"]
    both = mine.select(*within, *order, "__row", "__value").unionByName(theirs.select(*within, *order, "__row", "__value"))
    return last_value(both, within, order, F.col("__value"), name).filter("__late = 1").select("__row.*", name)


def topology_at(targets: DataFrame, topologies: DataFrame, time: str = "t") -> DataFrame:
    """targets with the generation in force at their time: the latest valid_from at or before it, then the higher generation.

    A target before the first has a null generation. Up to FEW topologies are sent to all tasks as one sorted array, and
    targets don't move.
    """
    if topologies.limit(FEW + 1).count() > FEW:
        return _merged(targets, topologies, [], time, "valid_from", F.col("generation"), "generation", ["generation"])
    steps = topologies.agg(F.sort_array(F.collect_list(F.struct("valid_from", "generation"))).alias("steps"))
    at = F.array_max(F.filter("steps", lambda x: x["valid_from"] <= F.col(time)))
    return targets.crossJoin(F.broadcast(steps)).withColumn("generation", at["generation"]).drop("steps")


def backup_shards(backups: DataFrame) -> DataFrame:
    return backups.select(F.col("id").alias("backup_id"), "completed_at", F.inline("shards"))


def newest_backup_before(targets: DataFrame, backups: DataFrame, time: str = "t") -> DataFrame:
    """targets (stanza, time) with label and stop_time of the stanza's newest backup that stopped at or before the time.

    backups: (stanza, label, stop_time), one row for each shard of a backup. Equal stop times: the smaller label. Where no
    stanza has more than FEW, its backups become one sorted array that each target looks into.
    """
    if (backups.groupBy("stanza").count().agg(F.max("count")).first()[0] or 0) > FEW:
        # of equal stop times the smaller label comes last
        ranked = backups.groupBy("stanza", "stop_time").agg(F.min("label").alias("label"))
        found = _merged(targets, ranked, ["stanza"], time, "stop_time", F.struct("label", "stop_time"), "__best", ["label"])
        return found.withColumns({"label": F.col("__best.label"), "stop_time": F.col("__best.stop_time")}).drop("__best")
    history = backups.groupBy("stanza").agg(F.sort_array(F.collect_list(F.struct("stop_time", "label"))).alias("history"))
    fits = F.filter("history", lambda x: x["stop_time"] <= F.col(time))
    latest = F.array_max(F.transform(fits, lambda x: x["stop_time"]))
    best = F.array_min(F.filter(fits, lambda x: x["stop_time"] == latest))
    return targets.join(history, "stanza", "left").withColumn("best", best).withColumns({"label": F.col("best.label"), "stop_time": F.col("best.stop_time")}).drop("best", "history")


def check_ids(catalog: Catalog) -> None:
    """Ids and generations are unique, so that no lookup depends on the catalog's order."""
    for frame, key, what in ((catalog.barriers, "id", "barrier"), (catalog.backups, "id", "backup"), (catalog.topologies, "generation", "topology generation")):
        twice = frame.groupBy(key).count().filter("count > 1").select(F.min(key)).first()[0]
        if twice is not None:
            raise RestoreError(f"{what} {twice} is in the catalog more than once")


def _one(frame: DataFrame, condition: Column, what: str):
    rows = frame.filter(condition).limit(1).collect()
    if not rows:
        raise RestoreError(f"{what} is not in the catalog")
    return rows[0]


def resolve(catalog: Catalog, barrier: str | None = None, time: datetime | None = None, backup: str | None = None, latest: bool = False) -> DataFrame:
    """The restore plan for exactly one kind of target: a row for each shard of the topology in force.

    A barrier is restored to its named points and verified by their LSNs; a time to that time on the latest timeline; a
    backup to the position at which it stopped. A plan that doesn't match its topology shard by shard is refused.
    """
    if sum((barrier is not None, time is not None, backup is not None, bool(latest))) != 1:
        raise RestoreError("a target is a barrier, a time, a backup or the latest: exactly one of them")
    check_ids(catalog)
    spark = catalog.topologies.sparkSession
    no, text = F.lit(False), F.lit(None).cast("string")
    if time is not None:
        at = spark.createDataFrame([(time,)], "t timestamp")
        generation = topology_at(at, catalog.topologies).first()["generation"]
        if generation is None:
            raise RestoreError(f"{time} is before the first topology")
        topology = _one(catalog.topologies, F.col("generation") == generation, f"generation {generation}")
        shards = catalog.topologies.filter(F.col("generation") == generation).select(F.inline("shards")).withColumn("t", F.lit(time))
        plan = newest_backup_before(shards.select("name", "stanza", "t"), backup_shards(catalog.backups))
        # as RFC 3339 writes it: fractions only where there are any
        stamp = F.regexp_replace(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.?0*Z$", "Z")
        plan = plan.select(F.col("name").alias("shard"), "stanza", F.col("label").alias("set"), F.lit("time").alias("target_type"), stamp.alias("target_value"), no.alias("target_exclusive"), F.lit("latest").alias("target_timeline"), text.alias("verify_lsn"))
    elif barrier is not None:
        row = _one(catalog.barriers, F.col("id") == barrier, f"barrier {barrier}")
        topology = _one(catalog.topologies, F.col("generation") == row["topology_generation"], f"generation {row['topology_generation']}")
        points = catalog.barriers.filter(F.col("id") == barrier).select(F.col("time").alias("t"), F.inline("shards"))
        plan = newest_backup_before(points, backup_shards(catalog.backups).select("stanza", "label", "stop_time"))
        plan = plan.select(F.col("name").alias("shard"), "stanza", F.col("label").alias("set"), F.lit("name").alias("target_type"), F.col("restore_point").alias("target_value"), no.alias("target_exclusive"), F.col("timeline").cast("string").alias("target_timeline"), F.col("lsn").alias("verify_lsn"))
    else:
        if latest:
            newest = catalog.backups.agg(F.max_by("id", F.struct("completed_at", "id"))).first()[0]
            if newest is None:
                raise RestoreError("there are no backups")
            backup = newest
        row = _one(catalog.backups, F.col("id") == backup, f"backup {backup}")
        topology = _one(catalog.topologies, F.col("generation") == row["topology_generation"], f"generation {row['topology_generation']}")
        own = backup_shards(catalog.backups.filter(F.col("id") == backup))
        plan = own.select(F.col("name").alias("shard"), "stanza", F.col("label").alias("set"), F.lit("lsn").alias("target_type"), F.col("stop_lsn").alias("target_value"), F.lit(True).alias("target_exclusive"), F.col("timeline").cast("string").alias("target_timeline"), F.col("stop_lsn").alias("verify_lsn"))
    for fault in [*snapshot_faults(topology), *plan_faults(topology, [r.asDict() for r in plan.collect()])]:
        raise RestoreError(fault)
    return plan.select(*PLAN_COLUMNS)


def snapshot_faults(topology) -> list[str]:
    """Why a topology snapshot can't rebuild routing; empty if it can."""
    where, out = f"generation {topology['generation']}", []
    if topology["hash_function"] != HASH:
        out.append(f"{where} was placed by {topology['hash_function']!r}, which is not known here")
    for s in topology["shards"]:
        if s["role"] not in ("data", "system"):
            out.append(f"{where}: shard {s['name']} has the role {s['role']!r}")
        if s["state"] not in STATES:
            out.append(f"{where}: shard {s['name']} has the state {s['state']!r}")
    if (n := sum(s["role"] == "system" for s in topology["shards"])) != 1:
        out.append(f"{where} has {n} system shards")
    seen = set()
    for t in topology["tables"] or ():
        if not t["schema"] or not t["name"]:
            out.append(f"{where} has a table without a full name")
            continue
        name = f"{t['schema']}.{t['name']}".lower()
        if name in seen:
            out.append(f"{where} has {name} twice")
        seen.add(name)
        if t["type"] == "sharded":
            if not t["shard_key_column"] or t["shard_key_type"] not in KEY_TYPES:
                out.append(f"{where}: sharded table {name} lacks a usable key")
        elif t["type"] != "global":
            out.append(f"{where}: table {name} has the type {t['type']!r}")
    return out


def plan_faults(topology, plan: list[dict]) -> list[str]:
    """Where a plan and its topology disagree. Both are a row for each shard of one cluster."""
    out, where = [], f"generation {topology['generation']}"
    stanzas = {}
    for s in topology["shards"]:
        if not s["stanza"]:
            out.append(f"{where}: shard {s['name']} has no stanza")
        if s["name"] in stanzas:
            out.append(f"{where} has shard {s['name']} twice")
        if s["stanza"] in stanzas.values():
            out.append(f"{where}: stanza {s['stanza']} belongs to two shards")
        stanzas[s["name"]] = s["stanza"]
    names = [p["shard"] for p in plan]
    out += [f"shard {n} is planned more than once" for n in sorted({n for n in names if names.count(n) > 1})]
    out += [f"shard {n} is planned but not in {where}" for n in names if n not in stanzas]
    out += [f"shard {n} of {where} has no plan" for n in stanzas if n not in names]
    for p in plan:
        if p["shard"] in stanzas and p["stanza"] != stanzas[p["shard"]]:
            out.append(f"shard {p['shard']} would be restored from {p['stanza']}, not {stanzas[p['shard']]}")
        if not p["set"]:
            out.append(f"shard {p['shard']} has no backup that is old enough")
        if p["target_type"] != "time" and not p["target_value"]:
            out.append(f"shard {p['shard']} has no {p['target_type']} to stop at")
        if p["target_type"] == "name" and not p["verify_lsn"]:
            out.append(f"shard {p['shard']} has no LSN to verify its restore point by")
    return out
