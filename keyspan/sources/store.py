"""Sharded tables in a folder: Parquet by shard, and versioned manifests that make changes visible at once.

Each change writes new files under a new version and then one manifest, which names for each table and shard the versions
that hold its rows. A manifest is created under a number nobody has used, so of two writers one wins and the other finds
out: data, checkpoints and sequence blocks that change together are in one manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions.keyspace import id_column, required, route_column
from keyspan.operators.merge import same_schema
from keyspan.plans.catalog import ShardCatalog, TableDef

GLOBAL_SHARD = "global"
EMPTY = {"version": 0, "tables": {}, "checkpoints": {}, "sequences": {}, "state": {}}


class StoreError(RuntimeError):
    """A change that was not made."""


class Conflict(StoreError):
    """Another writer was first."""


class Fenced(StoreError):
    """A write to a shard that is read-only for now."""

    code = "25006"


class Unreachable(StoreError):
    """A shard whose files can't be read."""

    code = "08006"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._fs.mkdirs(self._path(f"{self.root}/_manifests"))

    # --- manifests ------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None:
            if not known:
                return json.loads(json.dumps(EMPTY))
            version = known[-1]
        return json.loads(self._text(f"{self.root}/_manifests/{version:012d}.json"))

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, base: dict, change: Callable[[dict], None]) -> dict:
        """Writes base, changed, as the manifest after it; Conflict if that number is taken.

        Of two writers one wins where the file system's rename is atomic and doesn't replace (HDFS, local disks). Object
        stores don't promise that: there a store needs one writer at a time.
        """
        new = json.loads(json.dumps(base))
        change(new)
        new["version"] = base["version"] + 1
        final = self._path(f"{self.root}/_manifests/{new['version']:012d}.json")
        temp = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(json.dumps(new, sort_keys=True).encode())
        out.close()
        try:
            if self._fs.exists(final):
                raise Conflict(f"version {new['version']} is there already")
            self._files.rename(temp, final, self._no_options)  # fails if someone made it meanwhile
        except Conflict:
            self._fs.delete(temp, False)
            raise
        except Exception as error:
            self._fs.delete(temp, False)
            raise Conflict(f"version {new['version']} was made by another writer") from error
        return new

    # --- tables ---------------------------------------------------------------------------------------------------

    def create(self, table: str, schema: T.StructType, definition: TableDef | None = None) -> None:
        base = self.manifest()
        if table in base["tables"]:
            raise StoreError(f"{table} is there already")
        key = {} if definition is None or definition.key is None else {"key": definition.key, "key_type": definition.key_type}
        self.commit(base, lambda m: m["tables"].update({table: {"schema": schema.json(), "shards": {}, **key}}))

    def schema(self, table: str, manifest: dict | None = None) -> T.StructType:
        return T.StructType.fromJson(json.loads((manifest or self.manifest())["tables"][table]["schema"]))

    def read(self, table: str, shards: Sequence[str] | None = None, version: int | None = None, with_shard: bool = False) -> DataFrame:
        """Rows of a table, of some shards only if given: the other shards' folders are not opened."""
        m = self.manifest(version)
        entry = m["tables"][table]
        schema = self.schema(table, m)
        wanted = [(v, s) for s, vs in sorted(entry["shards"].items()) if shards is None or s in shards for v in vs]
        base = f"{self.root}/{table}"
        if not wanted:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn("shard", F.lit(None).cast("string")) if with_shard else empty
        full = T.StructType([*schema.fields, T.StructField("v", T.StringType()), T.StructField("shard", T.StringType())])
        try:
            df = self.spark.read.schema(full).option("basePath", base).parquet(*[f"{base}/v={v}/shard={s}" for v, s in wanted])
        except AnalysisException as error:
            raise Unreachable(f"files of {table} are not there: {error}") from error
        if shards is not None:
            df = df.filter(F.col("shard").isin(list(shards)))
        return df.select(*schema.names, *(["shard"] if with_shard else []))

    def _route(self, df: DataFrame, entry: dict, shards: ShardCatalog | None) -> DataFrame:
        if "key" not in entry:
            return df.withColumn("shard", F.lit(GLOBAL_SHARD))
        at = required(id_column(entry["key_type"], F.col(entry["key"])), f"a row has no {entry['key']} to place it by")
        return df.withColumn("shard", route_column(at, shards.shards))

    def write_files(self, table: str, df: DataFrame, shards: ShardCatalog | None, manifest: dict | None = None) -> tuple[str, list[str]]:
        """Writes rows, placed, as files of a new version that no manifest names yet; returns the version and its shards.

        AQE splits and merges what the rebalancing makes, so a shard with most rows is written by many tasks.
        """
        m = manifest or self.manifest()
        if not same_schema(self.schema(table, m), df.schema):
            raise StoreError(f"{table} has {self.schema(table, m).simpleString()}, not {df.schema.simpleString()}")
        version = uuid.uuid4().hex
        placed = self._route(df, m["tables"][table], shards).hint("rebalance", "shard")
        folder = f"{self.root}/{table}/v={version}"
        placed.write.partitionBy("shard").parquet(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        return version, sorted(self.spark._jvm.java.net.URLDecoder.decode(n.removeprefix("shard="), "UTF-8") for n in names if n.startswith("shard="))

    # --- fences ---------------------------------------------------------------------------------------------------

    def fence(self, shard: str, claim: str) -> dict:
        """Makes a shard read-only for everyone, until the same claim is given up; a shard has one claim at a time.

        Writers that began before find the manifest changed, and the shard fenced when they try again.
        """

        def change(m: dict) -> None:
            held = m["state"].setdefault("fences", {}).setdefault(shard, claim)
            if held != claim:
                raise Conflict(f"{shard} is claimed by {held}")

        return self.commit(self.manifest(), change)

    def unfence(self, shard: str, claim: str) -> bool:
        """Gives a claim up; False if the shard isn't fenced by it, which leaves it as it is."""
        base = self.manifest()
        if base["state"].get("fences", {}).get(shard) != claim:
            return False
        self.commit(base, lambda m: m["state"]["fences"].pop(shard))
        return True

    @staticmethod
    def _open(manifest: dict, shards: Sequence[str]) -> None:
        if shut := sorted(set(shards) & set(manifest["state"].get("fences", {}))):
            raise Fenced(f"{shut[0]} is read-only")

    def append(self, table: str, df: DataFrame, shards: ShardCatalog | None = None) -> dict:
        base = self.manifest()
        version, hit = self.write_files(table, df, shards, base)
        self._open(base, hit)

        def change(m: dict) -> None:
            for s in hit:
                m["tables"][table]["shards"].setdefault(s, []).append(version)

        return self.commit(base, change)

    def replace(self, table: str, of_shards: Sequence[str], df: DataFrame, shards: ShardCatalog | None = None, base: dict | None = None, also: Callable[[dict], None] | None = None) -> dict:
        """df becomes all rows of those shards; also: further changes of the same manifest."""
        base = base or self.manifest()
        self._open(base, of_shards)
        version, hit = self.write_files(table, df, shards, base)
        if set(hit) - set(of_shards):
            raise StoreError(f"rows of {sorted(set(hit) - set(of_shards))} among those of {sorted(of_shards)}")

        def change(m: dict) -> None:
            for s in of_shards:
                m["tables"][table]["shards"][s] = [version] if s in hit else []
            if also:
                also(m)

        return self.commit(base, change)

    # --- sequences ------------------------------------------------------------------------------------------------

    def create_sequence(self, name: str, block: int = 1000, start: int = 1) -> None:
        if not 1 <= block <= 1_000_000:
            raise StoreError(f"a block of {block} ids is not within 1 to 1,000,000")
        self.commit(self.manifest(), lambda m: m["sequences"].setdefault(name, {"next": start, "block": block}))

    def reserve(self, name: str, count: int | None = None, tries: int = 20) -> tuple[int, int]:
        """(first, number) of ids that nobody else gets; of the sequence's block size unless a count is given."""
        for _ in range(tries):
            base = self.manifest()
            if name not in base["sequences"]:
                raise StoreError(f"there is no sequence {name}")
            s = base["sequences"][name]
            n = s["block"] if count is None else count
            if n < 1 or s["next"] + n > 1 << 63:
                raise StoreError(f"{name} can't give {n} ids")
            try:
                self.commit(base, lambda m: m["sequences"][name].update(next=s["next"] + n))  # noqa: B023
                return s["next"], n
            except Conflict:
                continue
        raise StoreError(f"{name} is too busy")
