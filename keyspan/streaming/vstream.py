"""One change stream over all shards, with a position to resume from.

A position says for each shard the last commit that was handled; changes strictly after it follow. When a shard ends,
its journal names successors and where each starts, and the position goes on with them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.functions.keyspace import KeyRange, validate_partition

POSITION, LATEST, SNAPSHOT = "position", "latest", "snapshot_and_follow"


class StreamError(ValueError):
    """A stream that can't be started or continued."""


@dataclass(frozen=True)
class Position:
    shards: Mapping[str, int] = field(default_factory=dict)
    copied: frozenset[str] = frozenset()  # tables whose copy is complete

    def to_json(self) -> str:
        return json.dumps({"shards": dict(sorted(self.shards.items())), "copied": sorted(self.copied)})

    @classmethod
    def from_json(cls, text: str) -> Position:
        doc = json.loads(text)
        return cls({k: int(v) for k, v in doc["shards"].items()}, frozenset(doc.get("copied", ())))

    def after(self, shard: str, lsn: int) -> Position:
        """Never goes back."""
        return Position({**self.shards, shard: max(lsn, self.shards.get(shard, lsn))}, self.copied)

    def journal(self, ended: str, successors: Sequence[tuple[str, KeyRange, int]], source: KeyRange) -> Position:
        """The position once a shard has ended: its successors, each from its own start. They must divide its range."""
        if ended not in self.shards:
            raise StreamError(f"{ended} is not followed")
        ranges = sorted((r for _, r, _ in successors), key=lambda r: r.start)
        if not ranges or ranges[0].start != source.start or ranges[-1].end != source.end or any(a.stop != b.start for a, b in zip(ranges, ranges[1:], strict=False)):
            raise StreamError(f"the successors of {ended} don't divide {source}")
        rest = {k: v for k, v in self.shards.items() if k != ended}
        if clash := [n for n, _, _ in successors if n in rest]:
            raise StreamError(f"{clash[0]} is followed already")
        return Position({**rest, **{n: lsn for n, _, lsn in successors}}, self.copied)


def start(kind: str, changes: DataFrame, tables: Sequence[str] = (), position: Position | None = None) -> DataFrame:
    """changes (shard, commit_lsn, schema, table, ...) of a request: of these tables (all if none), from its start.

    latest: after what is there now. snapshot_and_follow: all, to follow a copy taken at the position's commits.
    """
    if kind not in (POSITION, LATEST, SNAPSHOT):
        raise StreamError("a request says where it starts")
    if kind == POSITION and position is None:
        raise StreamError("a start at a position needs one")
    wanted = changes.filter(F.concat_ws(".", "schema", "table").isin(list(tables))) if tables else changes
    if kind == LATEST:
        return follow(wanted, current(changes))
    return follow(wanted, position) if position is not None else wanted


def current(changes: DataFrame) -> Position:
    """The last commit of each shard: a row for each shard."""
    return Position({r["shard"]: r["lsn"] for r in changes.groupBy("shard").agg(F.max("commit_lsn").alias("lsn")).collect()})


def follow(changes: DataFrame, position: Position) -> DataFrame:
    """Changes strictly after the position; of a shard that it doesn't name, none: shards come in by journal only."""
    if not position.shards:
        return changes.limit(0)
    at = F.create_map(*[F.lit(x) for s, lsn in sorted(position.shards.items()) for x in (s, lsn)])
    return changes.filter(F.col("commit_lsn") > at[F.col("shard")])


def events(changes: DataFrame) -> DataFrame:
    """(shard, commit_lsn, n, kind, ...): begin, row and commit events, in order of (shard, commit_lsn, n)."""
    row = changes.select("shard", "commit_lsn", (F.col("seq") * 2 + 1).alias("n"), F.lit("row").alias("kind"), "op", "schema", "table", "was", "cells")
    ends = changes.groupBy("shard", "commit_lsn").agg((F.min("seq") * 2).alias("first"), (F.max("seq") * 2 + 2).alias("last"))
    none = [F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in ("op", "schema", "table", "was", "cells")]
    bracket = lambda n, kind: ends.select("shard", "commit_lsn", F.col(n).alias("n"), F.lit(kind).alias("kind"), *none)
    return bracket("first", "begin").unionByName(row).unionByName(bracket("last", "commit"))


def ddl_events(frames: DataFrame, prefix: str = "keyspan.ddl") -> DataFrame:
    """(shard, commit_lsn, kind, migration_id, sql): schema statements that travel as logical messages of a prefix.

    frames are decoded and committed ones; a message's content is the statement's id, a line feed, and its text.
    """
    text = F.decode("content", "UTF-8")
    rows = frames.filter((F.col("op") == "message") & (F.col("prefix") == prefix))
    return rows.select("shard", "commit_lsn", F.lit("ddl").alias("kind"), F.substring_index(text, "\n", 1).alias("migration_id"), F.expr("substring(decode(content, 'UTF-8'), instr(decode(content, 'UTF-8'), '\n') + 1)").alias("sql"))


def heartbeats(shards: DataFrame, changes: DataFrame) -> DataFrame:
    """(shard, kind): a heartbeat of each shard (shard) that has no change among these, so that silence isn't taken for loss."""
    return shards.select("shard").distinct().join(changes.select("shard").distinct(), "shard", "left_anti").withColumn("kind", F.lit("heartbeat"))


def copy_completed(position: Position, copied: Sequence[str]) -> tuple[Position, list[tuple[str, str]]]:
    """(position that knows of the copies, [(kind, table)] of those that are new): a table's copy is told once."""
    new = [t for t in dict.fromkeys(copied) if t not in position.copied]
    return Position(position.shards, position.copied | set(new)), [("copy_completed", t) for t in new]


def field_events(changes: DataFrame) -> DataFrame:
    """(schema, table, columns): the columns of each table as changes show them."""
    names = changes.filter("cells is not null").select("schema", "table", F.transform("cells", lambda c: c["name"]).alias("columns"))
    return names.distinct()


def covers(ranges: Mapping[str, KeyRange], position: Position) -> bool:
    """Whether the shards of a position divide the whole keyspace."""
    try:
        validate_partition([ranges[s] for s in position.shards])
    except (KeyError, ValueError):
        return False
    return True
