"""Applying change streams to stored tables, exactly once.

A batch's net effect and its checkpoint are in one manifest: either both are seen or neither. A batch that comes again
is dropped by its commit positions; a worker that was replaced finds its version taken and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.functions.keyspace import KeyRange, id_column, required, route_column, text_id_column
from keyspan.operators.placement import keep_range as keep_rows
from keyspan.plans.catalog import ShardCatalog
from keyspan.sources.copytext import typed
from keyspan.sources.pgoutput import decode_frames
from keyspan.sources.scratch import kept
from keyspan.sources.store import GLOBAL_SHARD, Conflict, Store
from keyspan.streaming.changes import ROW_OPS, keep_range, late, net_changes, row_changes, steps, transactions


class Applier:
    """Applies one consumer's changes to tables of a store.

    keys: the key columns of each table (schema.name), in the order of their relation's columns.
    """

    def __init__(self, store: Store, consumer: str, keys: dict[str, list[str]], shards: ShardCatalog | None = None):
        self.store, self.consumer, self.keys, self.shards = store, consumer, keys, shards

    def progress(self) -> dict:
        """{lsn: last applied commit, end_lsn: what the source may forget}."""
        return self.store.manifest()["checkpoints"].get(self.consumer, {"lsn": -1, "end_lsn": -1})

    def apply_frames(self, frames: DataFrame, r: KeyRange | None = None, shard_keys: dict[str, tuple[str, str]] | None = None) -> dict:
        """Transactions that were applied before are dropped by their commit positions, before they are decoded again."""
        done = self.progress()["lsn"]
        return self.apply(row_changes(transactions(decode_frames(frames, after=done), ROW_OPS, done)), r, shard_keys)

    def apply(self, changes: DataFrame, r: KeyRange | None = None, shard_keys: dict[str, tuple[str, str]] | None = None) -> dict:
        """Applies the changes after the checkpoint, all or none; returns the progress.

        r and shard_keys (table -> (column, type)): only rows whose shard key is in the range.
        """
        # read many times below: what is decoded is decoded once, and all of it is of one reading of the source
        changes = kept(changes, "changes")
        base = self.store.manifest()
        done = base["checkpoints"].get(self.consumer, {"lsn": -1, "end_lsn": -1})
        top = changes.agg(F.max("commit_lsn").alias("lsn"), F.max("end_lsn").alias("end_lsn")).first()
        if top["lsn"] is None:
            return done
        new = {"lsn": max(top["lsn"], done["lsn"]), "end_lsn": max(top["end_lsn"], done["end_lsn"])}
        moves: list[Callable[[dict], None]] = []
        if top["lsn"] > done["lsn"]:
            todo = late(changes, done["lsn"])
            for table in sorted(f"{x['schema']}.{x['table']}" for x in todo.select("schema", "table").distinct().collect()):
                if table not in base["tables"]:
                    raise ValueError(f"changes of {table}, which is not in the store")
                own = todo.filter(F.concat_ws(".", "schema", "table") == table)
                if r is not None:
                    own = kept(keep_range(own, *(shard_keys or {})[table], r), "range")  # read many times, too
                moves.append(self._rewrite(table, own, base))

        def change(m: dict) -> None:
            for move in moves:
                move(m)
            m["checkpoints"][self.consumer] = new

        self.store.commit(base, change)
        return new

    def _rewrite(self, table: str, changes: DataFrame, base: dict) -> Callable[[dict], None]:
        """Writes the touched shards anew. Where the shard key is part of the table's key, no other shard is read."""
        schema = self.store.schema(table, base)
        keys, entry = self.keys[table], base["tables"][table]
        stepped = steps(changes)
        by_key = "key" in entry and entry["key"] in keys
        shard_of = lambda position: route_column(required(position, "a row has no key to place it by"), self.shards.shards)
        if "key" not in entry:
            hit = [GLOBAL_SHARD]
        elif by_key:
            at = shard_of(text_id_column(entry["key_type"], F.col("key")[keys.index(entry["key"])]))
            hit = sorted(x["shard"] for x in stepped.select(at.alias("shard")).distinct().collect())
        else:
            hit = None
        current = self.store.read(table, hit, version=base["version"] or None, with_shard=True)
        as_key = F.array(*[F.col(k).cast("string") for k in keys])
        existing = current.select(as_key.alias("key")).join(stepped.select("key").distinct(), "key", "left_semi")
        net = net_changes(stepped, existing)
        value = lambda name: F.get(F.filter("cells", lambda c: c["name"] == name), F.lit(0))
        given = net.select("key", "op", *[F.struct(value(f.name)["kind"].alias("kind"), typed(value(f.name)["value"], f.dataType).alias("value")).alias(f"new_{f.name}") for f in schema])
        rows = current.withColumn("key", as_key).join(given, "key", "full_outer")
        kept = F.col("op").isNull() | (F.col("op") != "delete")
        # an unchanged cell keeps what is stored; where nothing is stored, it can't be known
        pick = lambda f: F.when(F.col("op").isNull() | (F.col(f"new_{f.name}.kind") == "unchanged"), F.col(f.name)).otherwise(F.col(f"new_{f.name}.value")).alias(f.name)
        result = rows.filter(kept).select(*[pick(f) for f in schema])
        if hit is None:
            at = shard_of(id_column(entry["key_type"], F.col(entry["key"])))
            new_shards = given.filter("op <> 'delete'").select(F.col(f"new_{entry['key']}.value").alias(entry["key"])).filter(F.col(entry["key"]).isNotNull()).select(at.alias("shard"))
            old_shards = current.withColumn("key", as_key).join(given.select("key"), "key", "left_semi").select("shard")
            hit = sorted(x["shard"] for x in new_shards.union(old_shards).distinct().collect())
            result = result.filter(at.isin(hit))
        version, written = self.store.write_files(table, result, self.shards, base)

        def change(m: dict) -> None:
            for s in hit:
                m["tables"][table]["shards"][s] = [version] if s in written else []

        return change

    def follow(self, frames: DataFrame, checkpoint: str, **options):
        """Starts applying a stream of frames as it comes; each micro-batch is a batch of apply_frames.

        Batches must hold whole transactions, as a log's files do.
        """

        def batch(df: DataFrame, _: int) -> None:
            self.apply_frames(df, **options)

        return frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def copy_range(store: Store, target: Store, table: str, r: KeyRange, column: str, kind: str, shards: ShardCatalog, version: int | None = None) -> int:
    """Copies the rows of a range, as of a version of the source, to an empty table of the target; returns their number."""
    base = target.manifest()
    if any(base["tables"][table]["shards"].values()):
        raise Conflict(f"{table} of the target is not empty")
    rows = keep_rows(store.read(table, version=version), column, kind, r)
    target.append(table, rows, shards)
    return target.read(table).count()
