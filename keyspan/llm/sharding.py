"""Shards by a Feistel permutation over global row numbers.

Rows get the numbers 0 to n - 1 in the order of doc_id. A Feistel network permutes a domain of fewer than 4n numbers;
cycle walking (apply it again while the value is n or more) makes that a permutation of 0 to n - 1. Permuted number p
goes to shard p mod shards at slot p div shards: counts differ by one at most, slots have no gaps, the shuffle is
reproducible from (seed, n), and both directions can be computed for any one row without looking at the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyspan.llm.common import stage
from keyspan.llm.tokens import mix

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, seed: int, i: int, mask: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD6E8FEB86659FD93) & (2**64 - 1))
        return mix(mix(half + key) ^ key) & mask


def _feistel(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    b, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> b, x & mask
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ _round(left, seed, i, mask), left
        else:
            left, right = right, left ^ _round(right, seed, i, mask)
    return (left << b) | right


def permute(x: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The image of row numbers below n, or with back their origin. Walks until every value is below n."""
    out = np.asarray(x, dtype=np.uint64)
    bits = _half_bits(n)
    out = _feistel(out, bits, seed, back)
    while len(at := np.flatnonzero(out >= np.uint64(n))):
        out[at] = _feistel(out[at], bits, seed, back)
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int = 24, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of one row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = 24, seed: int = 0) -> int:
    """The row number that has a shard and slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of docs (doc_id, text).

    Law `rows`: counts of shards differ by one at most. Rows are numbered by doc_id (nulls first), then by checksum
    and size; rows alike in all three are interchangeable. A null text has the size 8 and the checksum of no bytes.
    Equal texts are shuffled like any others. An empty table gives an empty result. Texts are not moved: only ids,
    sizes and checksums are.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    light = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    keys = ["doc_id", "text_crc32", "size"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the position within a sorted partition; kept as a table, for it must not be worked out twice
    ordered = stage(spark, light.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    # one row for each partition
    counts = ordered.groupBy(part.alias("part")).count()
    before = counts.select("part", (F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    n = ordered.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(permute(batch.column("p").to_numpy(), n, seed))], names=batch.schema.names)

    numbered = ordered.withColumn("part", part).join(F.broadcast(before), "part")
    rows = numbered.select("doc_id", "size", "text_crc32", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("p"))
    placed = rows.mapInArrow(place, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, p long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"p div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24, seed=0)
