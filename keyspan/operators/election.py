"""Failover election, instance identity and shard status, for all shards at once.

instances: (shard, pod, host, ready, is_primary, is_standby, received_lsn decimal(20,0), wal_receiver, observed,
system_id decimal(20,0), timeline, committed). committed, the pod a promotion was decided for, is the shard's and
repeated on its rows. A shard has a handful of instances, so its rows are aggregated, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Target rows behind the source by no more than this many bytes count as caught up.
LAG_BOUND = 16 << 20


def elect(instances: DataFrame) -> DataFrame:
    """(shard, warranted, wait, target): whether to fail over, whether to wait first, and whom to promote.

    Nothing while a ready primary exists, or with nobody to promote. Wait while any instance claims to be primary, has
    run but can't be seen, has no settled role, or still receives WAL. A committed target is kept to, or waited for; else
    the ready standby with the most WAL wins, the first by name among equals. Nobody behind WAL that was seen is promoted.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    is_target = flag(F.col("pod") == F.col("committed"))
    seen, primary, standby = (flag(F.col(c)) for c in ("observed", "is_primary", "is_standby"))
    candidate = flag(F.col("ready")) & standby
    any_of = lambda c: F.bool_or(c)
    s = instances.groupBy("shard").agg(
        F.max("committed").alias("committed"),
        any_of(primary & flag(F.col("ready"))).alias("has_primary"),
        any_of(primary).alias("claimed"),
        any_of(~seen & (F.coalesce("host", F.lit("")) != "")).alias("unseen"),
        any_of(seen & ~primary & ~standby & ~is_target).alias("unsettled"),
        any_of(flag(F.col("wal_receiver"))).alias("receiving"),
        any_of(is_target & seen & ~primary).alias("drivable"),
        F.max(F.when(is_target & seen & ~primary, F.col("received_lsn"))).alias("target_lsn"),
        F.max(F.when(seen, F.col("received_lsn"))).alias("most"),
        # the smallest (-lsn, pod) is the most advanced, the first by name among equals
        F.min(F.when(candidate, F.struct((-F.col("received_lsn")).alias("behind"), "pod"))).alias("best"),
    )
    nothing = F.col("has_primary") | (F.col("best").isNull() & ~F.col("drivable") & F.col("committed").isNull())
    unsafe = F.col("claimed") | F.col("unseen") | F.col("unsettled") | F.col("receiving")
    most = F.coalesce("most", F.lit(0))
    lags = F.when(F.col("committed").isNotNull(), ~F.col("drivable") | (F.col("target_lsn") < most)).otherwise(-F.col("best.behind") < most)
    wait = ~nothing & (unsafe | F.coalesce(lags, F.lit(True)))
    target = F.when(~nothing & ~wait, F.coalesce("committed", "best.pod"))
    return s.select("shard", (~nothing).alias("warranted"), wait.alias("wait"), target.alias("target"))


def assess_identity(instances: DataFrame, latched: DataFrame) -> DataFrame:
    """instances with verdict and suppress_primary, for latched (shard, latched_id decimal, latched_timeline, malformed).

    verdict: `kept`, `foreign` (another lineage: its WAL is not ours), `claimant` (a primary that nothing vouches for),
    `blocked` (of unknown identity or ahead of the recorded timeline: the election waits for it), `unverifiable` (the
    latch can't be read) or `conflict` (no latch yet, and two lineages). suppress_primary: no primary of the shard is
    believed. A claimant is vouched for by the latched id on exactly the recorded timeline.
    """
    v = instances.join(latched, "shard", "left")
    zero = F.lit(0).cast("decimal(20,0)")
    latch, line = F.coalesce("latched_id", zero), F.coalesce("latched_timeline", F.lit(0))
    own = F.coalesce("system_id", zero)
    seen = F.coalesce("observed", F.lit(False))
    lineages = v.filter(seen & (own != 0)).groupBy("shard").agg(F.count_distinct("system_id").alias("lineages"))
    v = v.join(lineages, "shard", "left")
    foreign, unknown = (own != 0) & (own != latch), seen & (own == 0)
    ahead = (line != 0) & (F.col("timeline") > line)
    vouched = (own == latch) & (line != 0) & (F.col("timeline") == line)
    primary = F.coalesce("is_primary", F.lit(False))
    verdict = (
        F.when(F.coalesce("malformed", F.lit(False)), "unverifiable")
        .when(latch == 0, F.when(F.coalesce("lineages", F.lit(0)) > 1, "conflict").otherwise("kept"))
        .when(F.coalesce(F.col("pod") == F.col("committed"), F.lit(False)) & ~foreign, "kept")
        .when(foreign, "foreign")
        .when(primary, F.when(vouched, "kept").otherwise("claimant"))
        .when(unknown | ahead, "blocked")
        .otherwise("kept")
    )
    v = v.withColumn("verdict", verdict).drop("lineages")
    bad = v.filter(F.col("verdict").isin("unverifiable", "conflict", "claimant")).select("shard").distinct().withColumn("suppressed", F.lit(True))
    return v.join(bad, "shard", "left").withColumn("suppress_primary", F.coalesce("suppressed", F.lit(False))).drop("suppressed")


def latch_identity(instances: DataFrame, latched: DataFrame) -> DataFrame:
    """(shard, system_id, timeline): each shard's latch after a poll; latched is (shard, latched_id, latched_timeline, current).

    Only the current primary and the pod that a promotion was decided for are believed. The first id that one of them
    reports is latched, unless instances disagree on it, and never replaced; its timeline is latched with it and moves on
    only through the committed pod.
    """
    own = F.coalesce("system_id", F.lit(0).cast("decimal(20,0)")) != 0
    seen = instances.filter(F.coalesce("observed", F.lit(False)) & own)
    v = seen.join(latched, "shard").withColumn("is_target", F.coalesce(F.col("pod") == F.col("committed"), F.lit(False)))
    v = v.withColumn("trusted", F.coalesce("is_primary", F.lit(False)) & (F.coalesce(F.col("pod") == F.col("current"), F.lit(False)) | F.col("is_target")))
    s = v.groupBy("shard").agg(F.count_distinct("system_id").alias("ids"), F.min(F.when(F.col("trusted"), F.col("system_id"))).alias("new_id"))
    out = latched.join(s, "shard", "left")
    unset = F.coalesce("latched_id", F.lit(0).cast("decimal(20,0)")) == 0
    out = out.withColumn("id", F.when(unset, F.when(F.col("ids") == 1, F.col("new_id"))).otherwise(F.col("latched_id")))
    line = F.coalesce("latched_timeline", F.lit(0))
    moves = v.join(out.select("shard", "id"), "shard").filter(F.col("trusted") & (F.col("system_id") == F.col("id")) & (F.col("is_target") | (line == 0))).groupBy("shard").agg(F.max("timeline").alias("seen_timeline"))
    return out.join(moves, "shard", "left").select("shard", F.col("id").alias("system_id"), F.greatest(line, F.coalesce("seen_timeline", F.lit(0))).alias("timeline"))


def parse_latched(text: str):
    """Column expression: a latched id from text, null if it is none; zero is none."""
    value = F.when(F.col(text).rlike(r"\A[0-9]{1,20}\z"), F.col(text).cast("decimal(38,0)"))
    return F.when((value > 0) & (value < F.lit(str(1 << 64)).cast("decimal(38,0)")), value.cast("decimal(20,0)"))


def shard_status(instances: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard, primary, phase) for shards (shard, replicas, had_primary, prefix); instances also have role: primary or replica, else unsettled.

    Several primaries are none, and Degraded. Ready has a primary and every wanted instance (prefix-0, prefix-1, ...) up in
    a settled role, whatever else is up. With nothing up and never a primary it is Provisioning, else Degraded.
    """
    up = F.coalesce("ready", F.lit(False)) & F.col("role").isin("primary", "replica")
    n = F.when(F.startswith("pod", F.concat("prefix", F.lit("-"))), F.substr("pod", F.length("prefix") + 2)).try_cast("int")
    wanted = F.coalesce((n >= 0) & (n < F.col("replicas")), F.lit(False))
    primary = F.col("role") == "primary"
    s = shards.join(instances.select("shard", "pod", "ready", "role"), "shard", "left").groupBy("shard").agg(
        F.first("replicas").alias("replicas"), F.first("had_primary").alias("had_primary"), F.count_if(primary).alias("primaries"), F.min(F.when(primary, F.col("pod"))).alias("pod"), F.count_if(up).alias("up"), F.count_distinct(F.when(up & wanted, n)).alias("wanted_up")
    )
    phase = F.when(F.col("primaries") > 1, "Degraded").when((F.col("wanted_up") == F.col("replicas")) & (F.col("primaries") == 1), "Ready").when((F.col("up") == 0) & ~F.col("had_primary"), "Provisioning").otherwise("Degraded")
    return s.select("shard", F.when(F.col("primaries") == 1, F.col("pod")).alias("primary"), phase.alias("phase"))


def cluster_phase(shards: DataFrame) -> DataFrame:
    """(cluster, phase) from shards (cluster, phase): Ready if all are; Provisioning if some are not but none is Degraded."""
    s = shards.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phase") == "Ready").alias("ready"), F.count_if(F.col("phase") == "Degraded").alias("degraded"))
    return s.select("cluster", F.when(F.col("ready") == F.col("n"), "Ready").when(F.col("degraded") == 0, "Provisioning").otherwise("Degraded").alias("phase"))


def catch_up(targets: DataFrame, bound: int = LAG_BOUND) -> DataFrame:
    """(source, min_applied, lag, caught_up) from targets (source, write_lsn, applied_lsn).

    lag is the source's write position less the least applied. A target without a position, or ahead of its source, holds
    the source back: something is not what it seems.
    """
    s = targets.groupBy("source").agg(F.max("write_lsn").alias("write_lsn"), F.min("applied_lsn").alias("min_applied"), F.max("applied_lsn").alias("max_applied"), F.count_if(F.col("applied_lsn").isNull()).alias("unknown"))
    sound = (F.col("unknown") == 0) & (F.col("max_applied") <= F.col("write_lsn"))
    lag = F.when(sound, F.col("write_lsn") - F.col("min_applied"))
    return s.select("source", "min_applied", lag.alias("lag"), F.coalesce(lag <= bound, F.lit(False)).alias("caught_up"))


def ordinal(pod: str, prefix: str):
    """Column expression: n of a pod named prefix-n, else null."""
    return F.regexp_extract(F.col(pod), rf"\A{prefix}-([0-9]+)\z", 1).try_cast("int")


def observed_status(polls: DataFrame) -> DataFrame:
    """polls (in_recovery, accepting, fenced, ...) with role and ready: an instance that is held down is never ready, whatever it last said."""
    return polls.withColumns({"role": F.when(F.col("in_recovery"), "standby").otherwise("primary"), "ready": F.col("accepting") & ~F.col("fenced")})


def phase_of_shard(node_phase: str = "phase"):
    """Column expression: the phase of a shard whose node is in a phase; one that isn't known yet is Provisioning."""
    return F.when(F.col(node_phase).isin("Ready", "FailingOver", "Degraded"), F.col(node_phase)).otherwise("Provisioning")


def identity_summary(assessed: DataFrame, latched: DataFrame) -> DataFrame:
    """(shard, status, reason, pods): what one poll says of each shard's identity, worst first; assessed as assess_identity gives it.

    A shard without a latch and without a conflict has no row. pods are those that aren't believed, by name: few, as a
    shard's instances are. An instance that has run but can't be seen leaves the matter open.
    """
    suspect = F.col("verdict").isin("foreign", "claimant", "conflict")
    s = assessed.groupBy("shard").agg(
        F.bool_or(F.col("verdict") == "conflict").alias("conflict"),
        F.sort_array(F.collect_set(F.when(suspect, F.col("pod")))).alias("pods"),
        F.bool_or(~F.coalesce("observed", F.lit(False)) & (F.coalesce("host", F.lit("")) != "")).alias("unseen"),
    )
    s = s.join(latched.select("shard", "latched_id", "malformed"), "shard")
    known = F.coalesce("latched_id", F.lit(0).cast("decimal(20,0)")) != 0
    reason = (
        F.when(F.coalesce("malformed", F.lit(False)), "MalformedIdentity")
        .when(F.col("conflict"), "IdentityConflict")
        .when(known & (F.size("pods") > 0), "ForeignInstance")
        .when(known & F.col("unseen"), "IncompleteObservation")
        .when(known, "Latched")
    )
    status = F.when(F.col("reason") == "Latched", "True").when(F.col("reason") == "IncompleteObservation", "Unknown").otherwise("False")
    return s.withColumn("reason", reason).filter("reason is not null").select("shard", status.alias("status"), "reason", "pods")
