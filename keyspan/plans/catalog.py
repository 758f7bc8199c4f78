"""What is sharded how, and where: table definitions, the shard catalog, and topology snapshots."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from keyspan.functions.keyspace import HASH, KEY_TYPES, KeyRange, KeyspaceError, canonical_bound, shard_function, validate_partition

SERVING, BUFFERED, READ_ONLY, DRAINING, HIDDEN = "Serving", "Buffered", "ReadOnly", "Draining", "Hidden"
STATES = (SERVING, BUFFERED, READ_ONLY, DRAINING, HIDDEN)


class TopologyError(KeyspaceError):
    """A topology that must not be used."""


@dataclass(frozen=True, order=True)
class TableName:
    schema: str
    name: str

    def __str__(self) -> str:
        return f"{self.schema}.{self.name}"

    @classmethod
    def of(cls, text: str) -> TableName:
        schema, dot, name = text.rpartition(".")
        return cls(schema if dot else "public", name)


@dataclass(frozen=True)
class TableDef:
    """key None: a global table, whole in one place."""

    key: str | None = None
    key_type: str | None = None
    function: str = HASH
    sequences: tuple[tuple[str, str], ...] = ()  # (column, sequence)

    def __post_init__(self) -> None:
        if self.key is not None:
            shard_function(self.function)
            if self.key_type is not None and self.key_type not in KEY_TYPES:
                raise KeyspaceError(f"no key type {self.key_type!r}")


GLOBAL = TableDef()
VSchema = Mapping[TableName, TableDef]


@dataclass(frozen=True)
class ShardCatalog:
    """An exact partition of the keyspace into named shards, in keyspace order."""

    shards: tuple[tuple[str, KeyRange], ...]

    @classmethod
    def of(cls, shards: Iterable[tuple[str, KeyRange]]) -> ShardCatalog:
        shards = sorted(shards, key=lambda s: s[1].start)
        names = [n for n, _ in shards]
        if len(set(names)) < len(names):
            raise KeyspaceError("two shards of one name")
        validate_partition([r for _, r in shards])
        return cls(tuple(shards))

    @classmethod
    def even(cls, parts: int) -> ShardCatalog:
        return cls.of((str(r), r) for r in KeyRange().split_evenly(parts))

    def route(self, position: int) -> str:
        lo, hi = 0, len(self.shards)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.shards[mid][1].start <= position else (lo, mid)
        return self.shards[lo][0]

    def all(self) -> list[str]:
        return [n for n, _ in self.shards]


@dataclass(frozen=True)
class Shard:
    name: str
    range: KeyRange
    state: str = SERVING
    primary: str | None = None  # pod


@dataclass(frozen=True)
class Topology:
    epoch: int
    generation: int
    lease_seconds: int
    hash_function: str
    shards: tuple[Shard, ...]
    tables: tuple[tuple[TableName, TableDef], ...] = ()
    gates: tuple[dict, ...] = field(default=())

    @classmethod
    def from_json(cls, doc: dict) -> Topology:
        """From the form that topologies are stored in; bounds must be spelled canonically."""
        try:
            return cls._from_json(doc)
        except TopologyError:
            raise
        except KeyspaceError as error:
            raise TopologyError(str(error)) from error

    @classmethod
    def _from_json(cls, doc: dict) -> Topology:
        shards = tuple(Shard(s["name"], KeyRange(canonical_bound(s["keyRange"].get("start", "")), canonical_bound(s["keyRange"]["end"]) if s["keyRange"].get("end") else None), s.get("state", SERVING), (s.get("primary") or {}).get("pod")) for s in doc.get("shards", ()))
        tables = []
        for t in doc.get("tables", ()):
            kind = t.get("type")
            if kind == "sharded":
                tables.append((TableName(t["schema"], t["name"]), TableDef(t.get("shardKeyColumn"), t.get("shardKeyType"), doc.get("hashFunction", HASH), tuple((x["column"], x["sequence"]) for x in t.get("sequences", ())))))
            elif kind == "global":
                tables.append((TableName(t["schema"], t["name"]), GLOBAL))
            else:
                raise TopologyError(f"table {t.get('name')} has the type {kind!r}")
        return cls(doc.get("epoch", 0), doc.get("topologyGeneration", 0), doc.get("writeLeaseSeconds", 10), doc.get("hashFunction", HASH), shards, tuple(tables), tuple(doc.get("gates", ())))

    def validate(self) -> Topology:
        """The topology itself if it may be used."""
        if self.epoch < 1:
            raise TopologyError("epochs start at 1")
        if not 1 <= self.lease_seconds <= 60:
            raise TopologyError(f"a write lease of {self.lease_seconds} s is not within 1 to 60")
        if self.generation < 1:
            raise TopologyError("generations start at 1")
        try:
            shard_function(self.hash_function)
            validate_partition([s.range for s in self.shards if s.state == SERVING])
        except KeyspaceError as error:
            raise TopologyError(str(error)) from error
        for s in self.shards:
            if s.state not in STATES:
                raise TopologyError(f"shard {s.name} has the state {s.state!r}")
        return self

    def catalog(self) -> ShardCatalog:
        names = [s.name for s in self.shards]
        if len(set(names)) < len(names):
            raise TopologyError("two shards of one name")
        return ShardCatalog.of((s.name, s.range) for s in self.shards if s.state == SERVING)

    def vschema(self) -> dict[TableName, TableDef]:
        out: dict[TableName, TableDef] = {}
        for name, table in self.tables:
            if name in out:
                raise TopologyError(f"table {name} is there twice")
            out[name] = table
        return out

    def routable(self) -> Topology:
        """The topology if a router may be built from it: without gates, and with each sharded table's key and type."""
        if self.gates:
            raise TopologyError("gates are not enforced here, so a topology with gates is refused")
        for name, t in self.tables:
            if t is not GLOBAL and (t.key is None or t.key_type is None):
                raise TopologyError(f"sharded table {name} lacks its key or key type")
        self.catalog(), self.vschema()
        return self
