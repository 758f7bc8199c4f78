"""Splitting a stored shard while writes go on: seed, catch up, and one switch.

Seeding writes the source's rows as files of the targets that no manifest names yet. Files that were appended to the
source meanwhile are seeded too, until nothing is left; the switch then happens in one manifest, and only if the source
is still as it was seeded. Rolling back is to forget the files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from keyspan.functions.keyspace import KeyRange
from keyspan.operators.topology import check_split
from keyspan.plans.catalog import ShardCatalog
from keyspan.sources.store import Conflict, Store, StoreError


@dataclass
class Reshard:
    store: Store
    source: str
    targets: Sequence[tuple[str, KeyRange]]
    catalog: ShardCatalog
    seeded: dict[str, dict[str, list[str]]] = field(default_factory=dict)  # table -> source version -> [new version, targets...]
    attempts: int = 0
    phase: str = "Pending"

    def __post_init__(self) -> None:
        ranges = dict(self.catalog.shards)
        if self.source not in ranges:
            raise StoreError(f"there is no shard {self.source}")
        check_split(ranges[self.source], [r for _, r in self.targets])
        self.after = ShardCatalog.of([*((n, r) for n, r in self.catalog.shards if n != self.source), *self.targets])
        self.phase = "Seeding"

    def _tables(self, manifest: dict) -> list[str]:
        return [t for t, e in sorted(manifest["tables"].items()) if "key" in e]

    def _left(self, manifest: dict) -> list[tuple[str, str]]:
        """(table, version) of source files that are not seeded."""
        return [(t, v) for t in self._tables(manifest) for v in manifest["tables"][t]["shards"].get(self.source, []) if v not in self.seeded.get(t, {})]

    def seed(self) -> int:
        """One pass over what is not seeded yet; returns how many sets of files that were."""
        manifest = self.store.manifest()
        left = self._left(manifest)
        for table, version in left:
            schema = self.store.schema(table, manifest)
            rows = self.store.spark.read.schema(schema).parquet(f"{self.store.root}/{table}/v={version}/shard={self.source}")
            new, hit = self.store.write_files(table, rows, self.after, manifest)
            if set(hit) - {n for n, _ in self.targets}:
                raise StoreError(f"rows of {self.source} that are none of its range")
            self.seeded.setdefault(table, {})[version] = [new, *hit]
        self.phase = "CatchingUp" if left else "ReadyToCutover"
        return len(left)

    @property
    def claim(self) -> str:
        """What the source is fenced under: this reshard alone, told by its targets."""
        return f"reshard of {self.source} to {', '.join(n for n, _ in self.targets)}"

    def freeze(self) -> None:
        """Makes the source read-only, so that what is left to seed comes to an end. Another reshard's claim is a Conflict."""
        self.store.fence(self.source, self.claim)
        self.phase = "CuttingOver"

    def rollback(self) -> bool:
        """Lets writes go on as before; files that were seeded stay usable. False if the fence isn't ours."""
        self.phase = "CatchingUp"
        return self.store.unfence(self.source, self.claim)

    def switch(self) -> dict:
        """The targets take the source's place, for all tables at once. Conflict if the source has changed: seed again."""
        self.attempts += 1
        base = self.store.manifest()
        if self._left(base):
            self.phase = "CatchingUp"
            raise Conflict(f"{self.source} has rows that are not seeded")

        def change(m: dict) -> None:
            for table in self._tables(m):
                shards = m["tables"][table]["shards"]
                for version in shards.pop(self.source, []):
                    new, *hit = self.seeded[table][version]
                    for s in hit:
                        shards.setdefault(s, []).append(new)
            m["state"]["catalog"] = [[n, str(r)] for n, r in self.after.shards]
            m["state"]["generation"] = m["state"].get("generation", 1) + 1
            if m["state"].get("fences", {}).get(self.source) == self.claim:
                del m["state"]["fences"][self.source]

        out = self.store.commit(base, change)
        self.phase = "SwitchedForward"
        return out

    def run(self, tries: int = 5) -> dict:
        """Seeds while writes go on, then freezes the source, seeds the rest and switches; rolls back if that fails."""
        for _ in range(tries):
            while self.seed():
                pass
            try:
                self.freeze()
                self.seed()
                return self.switch()
            except Conflict:
                self.rollback()
        raise Conflict(f"{self.source} changes faster than it is seeded")

    def counts(self) -> dict[str, int]:
        """Rows seeded of each table, to be held against the source's."""
        out = {}
        for table, versions in self.seeded.items():
            paths = [f"{self.store.root}/{table}/v={new}/shard={s}" for new, *hit in versions.values() for s in hit]
            out[table] = self.store.spark.read.schema(self.store.schema(table)).parquet(*paths).agg(F.count(F.lit(1))).first()[0] if paths else 0
        return out


def check_workflow(spec: dict, vschema: dict) -> None:
    """Whether a copy-and-follow workflow can be run: id, range, and sharded tables under their own names, columns and keys."""
    if not spec.get("id"):
        raise StoreError("a workflow needs an id")
    KeyRange.parse(spec.get("range", ""))
    if not spec.get("tables"):
        raise StoreError("a workflow needs tables")
    names = [t["name"] for t in spec["tables"]]
    if len(set(names)) < len(names):
        raise StoreError("a table is there twice")
    for t in spec["tables"]:
        known = vschema.get(t["name"])
        if known is None or known.key is None:
            raise StoreError(f"{t['name']} is not a sharded table")
        if (t.get("key", known.key), t.get("key_type", known.key_type)) != (known.key, known.key_type):
            raise StoreError(f"{t['name']} is sharded by {known.key} ({known.key_type})")
        if t.get("target", t["name"]) != t["name"] or t.get("columns") or t.get("from_standby"):
            raise StoreError("renamed tables, mapped columns and standby sources are not supported")
