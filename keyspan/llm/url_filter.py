"""URL rules by a Bloom filter cascade.

The keys are what a rule can say: a host or one of its parent domains, followed by a prefix of the path. The corpus's
complete key universe is known, so a cascade of Bloom filters decides membership exactly: the first level encodes the
listed keys, the second those unlisted keys of the universe that pass the first, the third the listed keys that pass
the second, and so on until no key is wrong. Applying it needs no join: each task holds the cascade, whose size is
known from counts before it is built and follows the listed keys that occur, not the corpus.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.common import stage
from keyspan.llm.tokens import mix

#: (action, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A cascade of more bits than this is not sent to the tasks; the rules are joined instead.
MOST_BITS = 1 << 28


class Level(NamedTuple):
    words: np.ndarray
    hashes: int
    seed: int

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), dtype=bool)
        for at in positions(h1, h2, self.hashes, len(self.words) * 64, self.seed):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def positions(h1: np.ndarray, h2: np.ndarray, hashes: int, bits: int, seed: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        one = mix(h1.view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        two = mix(h2.view(np.uint64) ^ one) | np.uint64(1)
        return [(one + np.uint64(i) * two) & np.uint64(bits - 1) for i in range(hashes)]


def listed(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: the parity of the first level that a key fails, or of their number."""
    out = np.zeros(len(h1), dtype=bool)
    open_ = np.arange(len(h1))
    for depth, level in enumerate(levels):
        has = level.has(h1[open_], h2[open_])
        out[open_] = has == (depth % 2 == 0)
        open_ = open_[has]
    return out


def shape(n: int, wrong: float) -> tuple[int, int]:
    """(bits, hashes) for n keys at a rate of wrong answers; bits is a power of two."""
    per_key = max(1.0, -np.log2(wrong))
    bits = 1 << max(6, int(np.ceil(np.log2(max(1, n) * per_key / np.log(2)))))
    return bits, int(np.ceil(per_key))


def build(spark: SparkSession, universe: DataFrame, wanted: Column) -> list[Level] | None:
    """The cascade for the keys (h1, h2) of universe for which wanted is true; None if it would be too large to send."""
    keys = universe.select("h1", "h2", wanted.alias("yes"))
    count = {x["yes"]: x["count"] for x in keys.groupBy("yes").count().collect()}
    n, rest = count.get(True, 0), count.get(False, 0)
    if not n:
        return []
    wrong = min(0.5, max(1e-9, n / max(1, rest) / 2))
    inside, outside, levels = keys.filter("yes"), keys.filter("not yes"), []
    while True:
        bits, hashes = shape(n, wrong)
        if bits > MOST_BITS:
            return None
        seed = len(levels) + 1

        def set_bits(batches: Iterator[pa.RecordBatch], bits=bits, hashes=hashes, seed=seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(np.concatenate(positions(*(batch.column(x).to_numpy() for x in ("h1", "h2")), hashes, bits, seed)))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

        # at most bits / 64 rows, a number fixed above
        found = inside.select("h1", "h2").mapInArrow(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(bits // 64, dtype=np.int64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        level = Level(words.view(np.uint64), hashes, seed)
        levels.append(level)

        def wrongly(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(level.has(*(batch.column(x).to_numpy() for x in ("h1", "h2")))))

        wrong_keys = stage(spark, outside.select("h1", "h2").mapInArrow(wrongly, "h1 long, h2 long"), "wrong")
        n = wrong_keys.count()
        if not n:
            return levels
        inside, outside, wrong = wrong_keys, inside, 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def probes_of(host: Column, path: Column, lengths: Sequence[int], most_labels: int) -> Column:
    """The keys a url can be listed under, the longest first: each of host and its parents with each prefix of a length.

    Only those of at most as many labels as any rule has: a host of very many labels has no more keys than others.
    """
    labels = F.split(host, "\\.")
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most_labels - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.flatten(F.array(*[F.when(F.length(path) >= n, F.transform(hosts, lambda h: F.struct((-F.length(h) - n).alias("size"), (-F.length(h)).alias("of_host"), F.concat(h, path.substr(1, n)).alias("key"), (h != "").alias("named")))).otherwise(F.array().cast("array<struct<size:int,of_host:int,key:string,named:boolean>>")) for n in lengths]))
    return F.transform(F.array_sort(F.filter(keys, lambda x: x["named"])), lambda x: x["key"])


def filter_urls(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of pages (page_id, url).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest that fits wins (of two
    as long, the one with the longer host). Where none fits the url is not listed, and the verdict is default. A null
    url, or one without ://, has an empty host and path, which no rule fits. Repeated rows are judged one by one. Hosts
    and paths may be of any length: a url has as many keys as the rules have labels and lengths, at most.
    """
    lengths = sorted({len(path) for _, _, path in rules})
    most_labels = max((host.count(".") + 1 for _, host, _ in rules), default=1)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    probed = urls.withColumn("probes", probes_of(F.col("host"), F.col("path"), lengths, most_labels))
    table = spark.createDataFrame(pa.table({"key": pa.array([host + path for _, host, path in rules], pa.string()), "action": pa.array([action for action, _, _ in rules], pa.string())}))
    universe = probed.select(F.explode("probes").alias("key")).distinct().join(table, "key", "left")
    universe = stage(spark, universe.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "action"), "universe")
    actions = sorted({x[0] for x in rules})
    cascades = [build(spark, universe, F.col("action").eqNullSafe(a)) for a in actions]
    if any(x is None for x in cascades):
        return _by_join(probed, table, default)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {x: batch.column(x).flatten().to_numpy() for x in ("h1", "h2")}
            starts = np.concatenate([[0], np.cumsum(batch.column("h1").value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            acts = np.full(len(flat["h1"]), -1)
            for i, levels in enumerate(cascades):
                acts[listed(levels, flat["h1"], flat["h2"])] = i
            hits = np.flatnonzero(acts >= 0)
            first = np.searchsorted(hits, starts[:-1])  # of each row, the first key that is listed
            at = np.where(first < len(hits), hits[np.minimum(first, max(0, len(hits) - 1))] if len(hits) else 0, -1)
            fits = (at >= 0) & (at < starts[1:])
            which = pa.array(np.where(fits, at - starts[:-1] + 1, 0).astype(np.int32))
            verdict = pa.array([actions[acts[a]] if ok else default for a, ok in zip(at, fits, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("page_id", "host", "path", "probes")] + [which, verdict], names=["page_id", "host", "path", "probes", "which", "verdict"])

    hashed = probed.select("page_id", "host", "path", "probes", F.transform("probes", lambda x: F.xxhash64(x)).alias("h1"), F.transform("probes", lambda x: F.xxhash64(F.lit("second"), x)).alias("h2"))
    kind = pages.schema["page_id"].dataType.simpleString()
    out = hashed.mapInArrow(judge, f"page_id {kind}, host string, path string, probes array<string>, which int, verdict string")
    return out.select("page_id", "host", "path", F.when(F.col("which") > 0, F.get("probes", F.col("which") - 1)).alias("rule"), "verdict")


def _by_join(probed: DataFrame, table: DataFrame, default: str) -> DataFrame:
    """The same verdicts where the rules in use are too many for a cascade that tasks can hold."""
    rows = probed.withColumn("row", F.monotonically_increasing_id())
    found = rows.select("row", F.posexplode("probes").alias("at", "key")).join(table, "key").groupBy("row").agg(F.min(F.struct("at", "key", "action")).alias("hit"))
    return rows.join(found, "row", "left").select("page_id", "host", "path", F.col("hit.key").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))


def op6_bloom_cascade_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP6_SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                        ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(action, rule_host, rule_path)
), fits AS (
  SELECT s.page_id, s.host, s.path, r.rule_host || r.rule_path AS rule, r.action,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC) AS n
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE n = 1
"""
