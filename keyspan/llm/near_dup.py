"""Near-duplicate documents: banded MinHash candidates, odd-sketch verification, exact confirmation.

Every document is a set of word shingles. Its MinHash samples are (a) grouped into bands, whose equality proposes
candidates, and (b) folded into an odd sketch: a bitmap in which every (sample number, sample) flips one bit. Two
sketches' XOR holds one flip for each sample that differs, so its population count estimates high similarities
precisely; pairs whose estimate is well below the threshold are dropped before anything large moves. The rest is
confirmed on the full shingle sets.

Pairs are never written out. Equal sets are one class from the start. Classes are linked in two passes: within buckets
by sketches, then within what the sketches link by the full sets. In either pass every member of a group is compared
with the group's leader first, which is linear in the group; only members that the leader doesn't hold are compared with
all others. Both are done in units of two blocks of bounded size, in memory, that return a spanning set of their links.
No group is capped, and only verified links join groups.

With 24 bands of 4 samples a pair at similarity 0.85 shares no band with probability 2e-8 (at 0.8: 4e-6), and fails
the sketch with probability 3e-5 (four standard deviations); pairs above the threshold fail less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.common import drop, small_batches, stage
from keyspan.llm.components import components, smallest_reachable
from keyspan.llm.tokens import list_column, mix, releasing, shingles, word_hashes

BANDS, ROWS, SKETCH_BITS = 24, 4, 256
WORDS = SKETCH_BITS // 64
SAMPLES = BANDS * ROWS
#: Classes of a block, and the shingles of a block when sets are compared.
BLOCK, BLOCK_SHINGLES = 128, 1 << 18

_KEYS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _KEYS[:SAMPLES], _KEYS[SAMPLES:] | np.uint64(1)


def min_samples(values: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty array of distinct 64-bit values."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 256):  # pieces that stay in the cache
        np.minimum(out, ((values[at : at + 256, None] ^ _XOR) * _MUL).min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """rows x BANDS keys of rows x SAMPLES samples."""
    groups = samples.reshape(len(samples), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), groups.shape[:2]).copy()
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + groups[:, :, j])
    return keys


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """rows x SKETCH_BITS/64 words: each (sample number, sample) flips one bit."""
    bit = mix(samples ^ mix(np.arange(SAMPLES, dtype=np.uint64))) % np.uint64(SKETCH_BITS)
    flips = np.zeros((len(samples), SKETCH_BITS), dtype=np.int64)
    np.add.at(flips, (np.arange(len(samples))[:, None], bit.astype(np.int64)), 1)
    return np.packbits((flips & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def estimate(xor_bits: float) -> float:
    """Jaccard similarity that the population count of two sketches' XOR speaks for."""
    share = min(2 * xor_bits / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(1 - share)


def most_bits(percent: int) -> int:
    """XOR counts above this are dropped: four standard deviations above a pair's at the threshold."""
    differ = 1 - percent / 100
    keep = 1 - 2 / SKETCH_BITS
    # flips are 2 * Binomial(SAMPLES, differ); a bit is set where their number is odd
    each = 1 - differ + differ * keep**2
    mean = SKETCH_BITS / 2 * (1 - each**SAMPLES)
    spread = SAMPLES * differ * percent / 100 * (2 * keep ** (2 * SAMPLES * differ)) ** 2  # from the number of samples that differ
    clash = mean * (1 - 2 * mean / SKETCH_BITS) * 2 * mean / SKETCH_BITS  # from flips that meet
    return int(np.ceil(mean + 4 * np.sqrt(spread + clash)))


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, bounds, words in word_hashes(column):
        values, at = shingles(words, bounds, k)
        for r in range(len(at) - 1):
            yield np.unique(values[at[r] : at[r + 1]])


def _print(values: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that stand for a set."""
    return np.add.reduce(values), np.add.reduce(mix(values))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sizes, prints, samples = [], [], []
                for values in _sets(batch.column("text"), k):
                    sizes.append(len(values))
                    if len(values):
                        prints.append(_print(values))
                        samples.append(min_samples(values))
                sizes = np.array(sizes, dtype=np.int64)
                full = sizes > 0
                some = np.array(samples, dtype=np.uint64).reshape(-1, SAMPLES)
                prints = np.array(prints, dtype=np.uint64).reshape(-1, 2)
                fp = np.zeros((len(sizes), 2), dtype=np.uint64)
                fp[full] = prints
                bound = lambda width: np.concatenate([[0], np.cumsum(full * width)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64)), list_column(band_keys(some).ravel(), bound(BANDS)), list_column(odd_sketch(some).ravel(), bound(WORDS))],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"],
                )

    return releasing(run)


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for first, last, bounds, words in word_hashes(batch.column("text")):  # a small batch for each piece of text
                    values, at = shingles(words, bounds, k)
                    sets = [np.unique(values[at[r] : at[r + 1]]) for r in range(len(at) - 1)]
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                    prints = np.array([_print(x) for x in sets], dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("rep").slice(first, last - first), pa.array(prints[:, 0]), pa.array(prints[:, 1]), list_column(np.concatenate(sets), ends)], names=["rep", "fp1", "fp2", "values"])

    return releasing(run)


def _likely(percent: int):
    limit = most_bits(percent)

    def pairs(unit: pa.Table, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of pairs of the first rows with the others that pass the sketch."""
        sketch = np.stack([unit.column(f"s{i}").to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)
        size = unit.column("n").to_numpy()
        ps, qs = [], []
        for i in range(first):
            bits = np.bitwise_count(sketch[first:] ^ sketch[i]).sum(axis=1)
            near = np.flatnonzero((bits <= limit) & (100 * np.minimum(size[first:], size[i]) >= percent * np.maximum(size[first:], size[i]))) + first
            ps.append(np.full(len(near), i))
            qs.append(near)
        return np.concatenate(ps), np.concatenate(qs)

    return pairs


def _exact(percent: int):
    def pairs(unit: pa.Table, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of pairs of the first rows with the others whose full sets reach the threshold."""
        lists = unit.column("values").combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        n = len(size)
        values, owner = lists.flatten().to_numpy(), np.repeat(np.arange(n), size)
        # only shingles that several members have count
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1 if len(group) else new
        owner, group = owner[several], group[several]
        group = np.unique(group, return_inverse=True)[1]
        common = np.zeros((first, n), dtype=np.float32)
        step = max(256, (1 << 20) // max(1, n))
        for lo in range(0, int(group[-1]) + 1 if len(group) else 0, step):
            part = slice(np.searchsorted(group, lo), np.searchsorted(group, lo + step))
            has = np.zeros((n, step), dtype=np.float32)
            has[owner[part], group[part] - lo] = 1
            common += has[:first] @ has.T
        both = size[:first, None] + size[None, :] - common
        p, q = np.nonzero(100 * common.astype(np.float64) >= percent * both.astype(np.float64))
        keep = q >= first
        return p[keep], q[keep]

    return pairs


def _in_units(pairs):
    """Runs pairs(unit, first) over rows sorted by family, b1, b2 and side; returns a spanning set (a, b) of each unit's links.

    The first rows of a unit, those of side 0, are compared with its other rows.
    """

    def spanned(unit: pa.Table) -> pa.RecordBatch:
        ids = unit.column("rep").to_numpy()
        first = int((unit.column("side").to_numpy() == 0).sum())
        p, q = pairs(unit, first) if 0 < first < len(ids) else (np.zeros(0, int),) * 2
        # a row can be on both sides: the smallest row of each id stands for it
        _, at, which = np.unique(ids, return_index=True, return_inverse=True)
        root = smallest_reachable(len(at), which[p], which[q])
        moved = np.flatnonzero(root != np.arange(len(at)))
        return pa.RecordBatch.from_arrays([pa.array(ids[at[root[moved]]]), pa.array(ids[at[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.stack([batch.column(c).to_numpy() for c in ("family", "b1", "b2")])
                cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    key = tuple(keys[:, lo].tolist())
                    if key != last and held:
                        yield spanned(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    last = key
        if held:
            yield spanned(pa.Table.from_batches(held))

    return releasing(run)


#: Rows up to which a table of a few numbers is sent to all tasks; larger ones are joined by their keys.
SMALL = 500_000


def _near(table: DataFrame) -> DataFrame:
    """A staged table for joining: sent along if it is small."""
    return F.broadcast(table) if table.count() <= SMALL else table


def _units(spark: SparkSession, first: DataFrame, others: DataFrame, weight: Column, most: int) -> DataFrame:
    """Rows of `first` and `others` (family, rep, ...), all narrow, dealt into units (family, b1, b2): a block of a family's first rows and one of its others.

    side tells them apart. weight is what a row counts for in a block of at most about `most`. Families with rows on one
    side only get none.
    """

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(weight) / most)).cast("int").alias(name))

    sizes = stage(spark, blocks(first, "n1").join(blocks(others, "n2"), "family"), "unit-sizes")
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = first.join(_near(sizes), "family").withColumns({"b1": at("n1"), "side": F.lit(0)}).withColumn("b2", over("n2"))
    two = others.join(_near(sizes), "family").withColumns({"b2": at("n2"), "side": F.lit(1)}).withColumn("b1", over("n1"))
    columns = ["family", "b1", "b2", "side", *[c for c in first.columns if c != "family"]]
    return one.select(columns).unionByName(two.select(columns))


def _compared(spark: SparkSession, dealt: DataFrame, pairs) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "family", "b1", "b2").sortWithinPartitions("family", "b1", "b2", "side", "rep").mapInArrow(_in_units(pairs), "a long, b long")


def _by_sketch(spark: SparkSession, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) that join all classes that sketches in common buckets link; (rep, weight): how many others it met in buckets)."""
    # one shuffle, for counting and for joining
    entries = classes.select(F.explode("bands").alias("family"), "rep").repartition("family")
    buckets = entries.groupBy("family").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("met")).filter("met > 1")
    shared = stage(spark, entries.join(buckets, "family"), "shared-buckets")
    sketches = classes.select("rep", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(WORDS)])
    lead = sketches.select(F.col("rep").alias("lead"), F.col("n").alias("lead_n"), *[F.col(f"s{i}").alias(f"l{i}") for i in range(WORDS)])
    bits = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"l{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("s0").bitwiseXOR(F.col("l0"))))
    near = (bits <= most_bits(percent)) & (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n"))
    others = shared.filter("rep <> lead")
    star = stage(spark, others.select("lead", "rep").distinct().join(sketches, "rep").join(lead, "lead").filter(near).select("lead", "rep"), "bucket-stars")
    # who isn't held by its bucket's leader is compared with the bucket's other members, if there are any
    alone = stage(spark, others.filter("met > 2").join(star, ["lead", "rep"], "left_anti").select("family", "rep"), "bucket-rest")
    members = others.filter("met > 2").join(alone.select("family").distinct(), "family", "left_semi").select("family", "rep")
    more = _compared(spark, _units(spark, alone, members, F.lit(1), BLOCK).join(sketches, "rep"), _likely(percent))
    links = stage(spark, star.select(F.col("lead").alias("a"), F.col("rep").alias("b")).unionByName(more).distinct(), "likely")
    met = stage(spark, shared.groupBy("rep").agg(F.sum("met").alias("weight")), "met")
    drop(shared, star, alone)
    return links, met


def _by_sets(spark: SparkSession, sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all of sets (rep, fp1, fp2, values) that are alike, within families of members (rep, fp1, fp2, n, weight, family).

    The leader is who met most others in buckets: the text that the others are copies of, rather than one of them.
    """
    best = F.max_by("rep", F.struct("weight", (-F.col("rep")).alias("small"))).alias("lead")
    members = stage(spark, members.join(members.groupBy("family").agg(best), "family"), "members")
    narrow = members.select("family", "rep", "fp1", "fp2", "n", "lead")
    lead, others = narrow.filter("rep = lead").drop("lead"), narrow.filter("rep <> lead").drop("lead")

    def linked(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
        dealt = stage(spark, _units(spark, first, second, F.col("n"), BLOCK_SHINGLES), "units")
        return stage(spark, _compared(spark, sets.join(_near(dealt), ["rep", "fp1", "fp2"]), _exact(percent)), name)

    star = linked(lead, others, "stars")
    held = star.select(F.col("a").alias("rep")).unionByName(star.select(F.col("b").alias("rep"))).distinct()
    alone = stage(spark, others.join(held, "rep", "left_anti"), "rest")
    several = others.groupBy("family").count().filter("count > 1").join(alone, "family", "left_semi").select("family")
    more = linked(alone.join(several, "family", "left_semi"), others.join(several, "family", "left_semi"), "more-links")
    return star.unionByName(more)


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs (doc_id, text; other columns are ignored).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of k-word shingles (A-Z
    lower-cased, words split at ASCII white space; fewer than k words: the whole sequence is one shingle). Null and
    wordless texts have no shingles and no links. component_id is the smallest doc_id reachable. Rows that repeat a
    doc_id are judged row by row, each by its own text: equal texts are one node, named by the smallest doc_id that has
    them, and different texts named by one doc_id share that node. A null doc_id links with nothing: its component_id is
    null and it is kept. An empty table gives an empty result.
    """
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = stage(spark, docs.mapInArrow(_signatures(k), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch array<long>"), "signatures")
    some = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = stage(spark, some.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    likely, met = _by_sketch(spark, classes.withColumnRenamed("n_shingles", "n"), percent)
    families = components(spark, likely).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    members = stage(spark, classes.select("rep", "fp1", "fp2", F.col("n_shingles").alias("n")).join(families, "rep").join(met, "rep"), "family-members")
    reps = members.select("rep").distinct()
    reps = F.broadcast(reps) if members.count() <= 4 * SMALL else reps
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(reps, "rep", "left_semi")
    # rows that repeat an id are there once for each of its texts; where no id repeats, nothing has to move for that
    again = stage(spark, sig.select(F.col("doc_id").alias("rep")).join(reps, "rep", "left_semi").groupBy("rep").count().filter("count > 1").select("rep"), "repeated-ids")
    if again.limit(1).count():
        texts = texts.join(again, "rep", "left_anti").unionByName(texts.join(again, "rep", "left_semi").dropDuplicates(["rep", "text"]))
    sets = stage(spark, texts.mapInArrow(_full_sets(k), "rep long, fp1 long, fp2 long, values array<long>"), "sets")
    links = _by_sets(spark, sets, members, percent)
    found = stage(spark, components(spark, links), "components")
    drop(likely, met, members, sets)
    out = sig.select("doc_id", "n_shingles", "fp1", "fp2").join(classes.select("fp1", "fp2", "n_shingles", "rep"), ["fp1", "fp2", "n_shingles"], "left")
    # a null id is in no class
    out = out.withColumn("rep", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("rep", "doc_id")))
    out = out.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85, k=5)


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
), least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON d.doc_id = node LEFT JOIN n ON n.doc_id = d.doc_id
"""
