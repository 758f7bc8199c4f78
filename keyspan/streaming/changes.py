"""Row changes from decoded frames: transactions, key ranges, net effect.

changes: (shard, seq, commit_lsn, end_lsn, op, schema, table, key array<string>, old_key array<string>, cells
array<struct<name,kind,value>>): a row for each insert, update and delete of a committed transaction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyspan.functions.keyspace import KeyRange, in_range, text_id_column
from keyspan.operators.running import last_value, running_sum
from keyspan.sources.scratch import kept

ROW_OPS = ("insert", "update", "delete")
#: Frames that can't be applied without guessing.
REFUSED = ("truncate", "stream_start", "stream_stop", "stream_commit", "stream_abort", "begin_prepare", "prepare", "commit_prepared", "rollback_prepared", "stream_prepare")

#: Descriptions of relations that are sent along with changes.
FEW = 1000


def fail(message: str | Column) -> Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message)


def transactions(frames: DataFrame, ops: Sequence[str] | None = None, after: int | None = None) -> DataFrame:
    """Frames of committed transactions, each with its transaction's commit_lsn and end_lsn; what can't be applied is an error.

    Frames of one shard are in order of seq; a transaction's changes stand between its begin and its commit, and share the
    number of begins before them. decode_frames tells it (`txn`) and the commit's positions (`txn_lsn`, `txn_end`); they are
    worked out here where frames don't have them. A last transaction without a commit is left out. Of others than relations,
    only those of `ops` and of transactions after a position are given, if these are named.
    """
    told = "txn_lsn" in frames.columns
    if "txn" not in frames.columns:
        frames = running_sum(frames, ["shard"], ["seq"], (F.col("op") == "begin").cast("long"), "txn")
    if not told:
        frames = kept(frames, "frames")  # read for the commits and for all else
    rows = frames.withColumn("op", F.when(F.col("op").isin(*REFUSED), fail(F.concat(F.lit("can't apply "), F.col("op")))).otherwise(F.col("op")))
    if not told:
        ends = rows.filter("op = 'commit'").select("shard", "txn", F.col("commit_lsn").alias("txn_lsn"), F.col("end_lsn").alias("txn_end"))
        rows = rows.join(ends, ["shard", "txn"], "left")
    # relations may be described between transactions
    rows = rows.filter("txn_lsn is not null or op = 'relation'")
    if ops is not None:
        rows = rows.filter(F.col("op").isin("relation", *ops))
    if after is not None:
        rows = rows.filter((F.col("op") == "relation") | (F.col("txn_lsn") > after))
    rows = rows.drop("commit_lsn", "end_lsn").withColumnsRenamed({"txn_lsn": "commit_lsn", "txn_end": "end_lsn"})
    return kept(rows, "frames") if told else rows  # what decoded them does so once


def _named(cells: str, columns: str) -> Column:
    wide = F.when(F.size(cells) == F.size(columns), F.col(cells)).otherwise(fail("a row has another number of cells than its relation of columns"))
    return F.when(F.col(cells).isNotNull(), F.zip_with(columns, wide, lambda c, v: F.struct(c["name"].alias("name"), v["kind"].alias("kind"), F.decode(v["value"], "UTF-8").alias("value"), ((c["flags"].bitwiseAND(F.lit(1))) == 1).alias("is_key"))))


def _key(cells: Column) -> Column:
    keys = F.filter(cells, lambda c: c["is_key"])
    usable = F.transform(keys, lambda c: F.when(c["kind"] == "text", c["value"]).otherwise(fail("a key cell that is null, unchanged or binary")))
    return F.when(cells.isNotNull(), F.when(F.size(keys) > 0, usable).otherwise(fail("a change without a key")))


def _related(committed: DataFrame, described: Column) -> DataFrame:
    """Changes with the last description of their relation before them. Few descriptions are sent to all tasks; more are merged with the changes."""
    by = ["shard", "rel_oid"]
    told = committed.filter("op = 'relation'").select(*by, "seq", described.alias("relation"))
    if told.limit(FEW + 1).count() > FEW:
        return last_value(committed.filter(F.col("op").isin("relation", *ROW_OPS)), by, ["seq"], described, "relation").filter(F.col("op").isin(*ROW_OPS))
    versions = told.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.sort_array(F.collect_list(F.struct("seq", "relation"))).alias("__versions"))
    rows = committed.filter(F.col("op").isin(*ROW_OPS))
    same = rows["shard"].eqNullSafe(versions["__shard"]) & rows["rel_oid"].eqNullSafe(versions["__rel_oid"])
    last = F.try_element_at(F.filter("__versions", lambda v: v["seq"] <= F.col("seq")), F.lit(-1))["relation"]
    return rows.join(F.broadcast(versions), same, "left").withColumn("relation", last).drop("__shard", "__rel_oid", "__versions")


def row_changes(committed: DataFrame) -> DataFrame:
    """changes from transactions(): relations are looked up as of each change.

    Updates and deletes need a key identity (default or index); full and nothing are errors, for they may match several rows.
    """
    described = F.when(F.col("op") == "relation", F.struct("schema", "table", "replica_identity", "columns"))
    rows = _related(committed, described)
    rows = rows.withColumn("relation", F.when(F.col("relation").isNotNull() | ~F.col("op").isin(*ROW_OPS), F.col("relation")).otherwise(fail("a change of a relation that was not described")))
    rows = rows.withColumn("columns", F.col("relation.columns"))
    after, before = _named("after", "columns"), _named("before", "columns")
    identity = F.when((F.col("op") == "insert") | F.col("relation.replica_identity").isin("d", "i"), True).otherwise(fail("an update or delete without a key identity"))
    rows = rows.filter(identity).withColumns({"now": after, "was": before})
    new_key = F.when(F.col("op") != "delete", _key(F.coalesce("now", "was")))
    old_key = F.when(F.col("op") == "update", _key(F.coalesce("was", "now"))).when(F.col("op") == "delete", _key(F.col("was")))
    full = F.when(F.col("op") == "insert", F.transform("now", lambda c: F.when(c["kind"] == "unchanged", fail("an insert with an unchanged cell")).otherwise(c))).otherwise(F.col("now"))
    cells = F.transform(full, lambda c: F.struct(c["name"].alias("name"), c["kind"].alias("kind"), c["value"].alias("value")))
    was = F.transform("was", lambda c: F.struct(c["name"].alias("name"), c["kind"].alias("kind"), c["value"].alias("value")))
    return rows.select("shard", "seq", "commit_lsn", "end_lsn", "op", "relation.schema", "relation.table", new_key.alias("key"), old_key.alias("old_key"), cells.alias("cells"), was.alias("was"))


def _cell_position(cells: str, column: str, kind: str) -> Column:
    cell = F.get(F.filter(cells, lambda c: c["name"] == column), F.lit(0))
    text = F.when(cell["kind"] == "text", cell["value"]).otherwise(fail(f"the shard key {column} is null, unchanged or binary"))
    at = text_id_column(kind, text)
    return F.when(F.col(cells).isNotNull(), F.when(at.isNotNull(), at).otherwise(fail(f"a value of the shard key {column} is not one of its type")))


def keep_range(changes: DataFrame, column: str, kind: str, r: KeyRange) -> DataFrame:
    """Changes of rows whose shard key is in the range. An update that takes a row over its edge is an error."""
    inside = in_range(_cell_position("cells", column, kind), r)
    was_inside = in_range(_cell_position("was", column, kind), r)
    crosses = (F.col("op") == "update") & F.col("was").isNotNull() & (inside != was_inside)
    keep = F.when(F.col("op") == "delete", was_inside).when(crosses, fail("an update moves a row over the edge of the range")).otherwise(inside)
    return changes.filter(keep)


def steps(changes: DataFrame) -> DataFrame:
    """One row for each key that a change touches: an update of a key is a delete of the old and an insert of the new.

    part orders the two; before says what must be there: `absent` or `present`.
    """
    moved = (F.col("op") == "update") & (F.col("key") != F.col("old_key"))
    as_rows = F.when(moved, F.array(F.struct(F.lit(0).alias("part"), F.lit("delete").alias("op"), F.col("old_key").alias("key")), F.struct(F.lit(1).alias("part"), F.lit("insert").alias("op"), F.col("key").alias("key")))).otherwise(
        F.array(F.struct(F.lit(0).alias("part"), F.col("op").alias("op"), F.coalesce("key", "old_key").alias("key")))
    )
    rows = changes.withColumn("step", F.explode(as_rows)).withColumn("moved_from", F.when(moved & (F.col("step.op") == "insert"), F.col("old_key")))
    return rows.select("shard", "seq", "commit_lsn", "end_lsn", "schema", "table", "step.part", "step.op", "step.key", "moved_from", F.when(F.col("step.op") != "delete", F.col("cells")).alias("cells"), F.when(F.col("step.op") == "insert", "absent").otherwise("present").alias("before"))


def net_changes(stepped: DataFrame, existing: DataFrame, order: Sequence[str] = ("commit_lsn", "seq", "part")) -> DataFrame:
    """(key, op, cells): what a batch of one table's steps comes to for each key, op being `upsert` or `delete`.

    existing: keys (key array<string>) that the target holds. Each step must find its key as it needs it, given the steps
    before; a target that has drifted from its source is an error, not repaired. Cells that an update left unchanged keep
    the value of the last step that gave one; where that is before the batch they stay `unchanged`.
    """
    of_key = W.partitionBy("key")
    by = of_key.orderBy(*order)
    held = existing.select("key").distinct().withColumn("held", F.lit(True))
    rows = stepped.join(held, "key", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    there = F.when(F.lag("op").over(by).isNull(), F.col("held")).otherwise(F.lag("op").over(by) != "delete")
    sound = F.when(there == (F.col("before") == "present"), True).otherwise(fail(F.concat(F.col("op"), F.lit(" of a key that is "), F.when(there, "there").otherwise("not there"), F.lit(": "), F.array_join("key", ","))))
    # a delete starts the row anew, so only cells after the last delete carry over; so does a step that gives all cells
    gone = F.col("op") == "delete"
    whole = ~gone & (F.size("cells") >= F.col("widest")) & F.forall("cells", lambda c: c["kind"] != "unchanged")
    rows = rows.withColumns({"sound": sound, "widest": F.max(F.when(~gone, F.size("cells"))).over(of_key)})
    rows = rows.withColumn("epoch", F.sum((gone | F.coalesce(whole, F.lit(False))).cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumns({"last_epoch": F.max("epoch").over(of_key), "all_sound": F.bool_and("sound").over(of_key)})
    # the steps are read once: from here on there are the last few of each key
    ends = rows.filter("all_sound and epoch = last_epoch")
    given = F.when(~gone, F.col("cells"))
    cells = ends.select("key", "held", F.struct(*order, "op").alias("step"), F.posexplode_outer(given).alias("i", "cell"))
    known = F.struct((F.col("cell.kind") != "unchanged").alias("given"), "step")
    best = cells.groupBy("key", "i").agg(F.max("step").alias("step"), F.max_by("cell", known).alias("cell"), F.first("held").alias("held"))
    folded = best.groupBy("key").agg(F.max("step")["op"].alias("op"), F.first("held").alias("held"), F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "cell")))).alias("folded"))
    # inserted and deleted within the batch: nothing to do
    out = folded.filter("held or op <> 'delete'")
    return out.select("key", F.when(F.col("op") == "delete", "delete").otherwise("upsert").alias("op"), F.when(F.size("folded") > 0, F.transform("folded", lambda x: x["cell"])).alias("cells"), "held")


def late(changes: DataFrame, checkpoint: int) -> DataFrame:
    """Changes not yet applied. The transaction at the checkpoint was: sources send it again."""
    return changes.filter(F.col("commit_lsn") > checkpoint)
