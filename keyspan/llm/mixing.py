"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's weight is its token share to the power alpha, normalised. alpha = 1 keeps the shares; smaller values lift
small sources, which raises both the entropy of the mix and the number of times their documents repeat. Two bisections
find the largest alpha that reaches the target entropy and the smallest that keeps to the repetition limit; the limit
wins. Weights become token quotas of a budget: a source's documents are taken in whole passes, and the remainder of its
quota from a pseudo-random permutation of them, in blocks. Blocks are summed before any row is looked at, and only the
one block in which the quota ends is gone through by row, so a source with most of the corpus needs no single task
for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyspan.llm.common import drop, stage

#: Blocks of a source's permutation: the leading bits of the documents' keys.
BLOCK_BITS = 12
#: Sources up to which their table (five numbers each) is sent to all tasks.
SMALL = 100_000
STEPS = 60


#: A word: a run without ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """The number of words. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _key(seed: int) -> Column:
    """63 bits that order a source's documents."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1)


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))


def _bisect(ok, keep_low: bool) -> Column:
    """The end of [0, 1] up to which ok(alpha) holds, by halving; ok must be monotone. keep_low: it holds for small alpha."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        good = ok(mid)
        up = good if keep_low else ~good
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    return end["lo"] if keep_low else end["hi"]


def source_weights(totals: DataFrame, target_entropy: float, most_repeats: float, budget: int | None) -> DataFrame:
    """(source, tokens, alpha, weight, quota) for totals (source, tokens): a row for each source with tokens.

    target_entropy is a share of the highest possible, ln(number of sources). budget None: the fewest tokens with
    which every document is used at least once.
    """
    every = totals.filter("tokens > 0").agg(F.sort_array(F.collect_list(F.struct("tokens", "source"))).alias("all"), F.sum("tokens").cast("double").alias("sum"))
    every = every.withColumn("p", F.transform("all", lambda x: x["tokens"] / F.col("sum"))).withColumn("p_max", F.array_max("p")).withColumn("p_min", F.array_min("p"))

    def entropy(alpha: Column) -> Column:
        # of w = p^a / z: ln z - a / z * sum(p^a ln p)
        z = _sum(F.col("p"), lambda p: F.pow(p, alpha))
        return F.log(z) - alpha / z * _sum(F.col("p"), lambda p: F.pow(p, alpha) * F.log(p))

    def repeats(alpha: Column) -> Column:
        if budget is None:  # the largest source sets the budget
            return F.pow(F.col("p_max") / F.col("p_min"), 1 - alpha)
        return F.lit(float(budget)) / F.col("sum") * F.pow(F.col("p_min"), alpha - 1) / _sum(F.col("p"), lambda p: F.pow(p, alpha))

    slack = 1e-12
    by_entropy = F.when(entropy(F.lit(1.0)) >= target_entropy * F.log(F.size("p")) - slack, F.lit(1.0)).otherwise(_bisect(lambda a: entropy(a) >= target_entropy * F.log(F.size("p")) - slack, keep_low=True))
    by_repeats = F.when(repeats(F.lit(0.0)) <= most_repeats + slack, F.lit(0.0)).otherwise(_bisect(lambda a: repeats(a) <= most_repeats + slack, keep_low=False))
    every = every.withColumn("alpha", F.greatest(by_entropy, by_repeats))
    every = every.withColumn("z", _sum(F.col("p"), lambda p: F.pow(p, F.col("alpha"))))
    full = F.lit(float(budget)) if budget is not None else F.col("sum") * F.pow("p_max", 1 - F.col("alpha")) * F.col("z")
    rows = every.select("alpha", "z", "sum", full.alias("budget"), F.explode("all").alias("s"))
    weight = F.pow(F.col("s.tokens") / F.col("sum"), F.col("alpha")) / F.col("z")
    return rows.select("s.source", "s.tokens", "alpha", weight.alias("weight"), F.round(weight * F.col("budget")).cast("long").alias("quota"))


def mix_sources(spark: SparkSession, docs: DataFrame, target_entropy: float = 0.98, most_repeats: float = 2.0, budget: int | None = None, seed: int = 0, prefix: str = "mix_") -> DataFrame:
    """docs (doc_id, text, source, any others) with mix_tokens, mix_alpha, mix_weight, mix_quota and mix_copies.

    mix_copies is how often a document is in the mix: its source's whole passes, and one more for documents at the
    front of the permutation until the quota is used up (to less than a document). A null source is a source of its
    own. Documents without tokens cost nothing and are in the mix once; a source of only those has a null weight. Rows
    that repeat a doc_id of a source stand at one place of the permutation and are in or out together. Columns of docs
    that begin with the prefix are replaced, others stay. An empty table gives an empty result.
    """
    light = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("tokens"))
    # written, so that texts are gone through once
    counted = stage(spark, light.filter("tokens > 0").select("source", "tokens", _key(seed).alias("key")), "tokens")
    light = counted.withColumn("block", F.shiftright("key", 63 - BLOCK_BITS))
    blocks = stage(spark, light.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    weights = source_weights(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), target_entropy, most_repeats, budget)
    weights = stage(spark, weights.withColumn("passes", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens")), "weights")
    small = weights.count() <= SMALL
    near = F.broadcast if small else (lambda x: x)
    of_source = lambda one, other: one["source"].eqNullSafe(other["source"])

    # the block in which the rest of the quota ends, and what is left of it there
    upto = F.sum("tokens").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, 0))
    rest = weights.select("source", "rest")
    run = blocks.withColumn("upto", upto)
    last = run.join(near(rest), of_source(run, rest)).select(run["source"], "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"), "upto", "rest").filter("upto > rest and left >= 0")
    last = last.groupBy("source").agg(F.min(F.struct("block", "left")).alias("x")).select("source", F.col("x.block").alias("block"), F.col("x.left").alias("left"))
    last = stage(spark, last, "last-blocks")
    inside = light.join(near(last), of_source(light, last) & (light["block"] == last["block"])).select(light["source"], "key", "tokens", "left")
    fits = inside.withColumn("upto", F.sum("tokens").over(W.partitionBy("source").orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow))).filter(F.col("upto") <= F.col("left"))
    cut = fits.groupBy("source").agg(F.max("key").alias("cut"))
    plan = weights.join(last, of_source(weights, last), "left").drop(last["source"]).drop("left")
    plan = plan.join(cut, of_source(plan, cut), "left").drop(cut["source"])
    col = lambda name: F.col(prefix + name)
    plan = stage(spark, plan.select(F.col("source").alias(prefix + "source"), F.col("alpha").alias(prefix + "alpha"), F.col("weight").alias(prefix + "weight"), F.col("quota").alias(prefix + "quota"), F.col("passes").alias(prefix + "passes"), F.col("block").alias(prefix + "end_block"), F.col("cut").alias(prefix + "end_key")), "plan")
    drop(counted, blocks, weights, last)

    rows = docs.drop(*[c for c in docs.columns if c.lower().startswith(prefix.lower())])
    rows = rows.join(near(plan), F.col("source").cast("string").eqNullSafe(col("source")), "left")
    key = _key(seed)
    block = F.shiftright(key, 63 - BLOCK_BITS)
    # no end: the rest of the quota is nothing, and no block was entered
    extra = (block < col("end_block")) | ((block == col("end_block")) & (key <= col("end_key")))
    some = F.coalesce(F.col("text").rlike(TOKEN), F.lit(False))
    rows = rows.withColumn(prefix + "tokens", n_tokens(F.col("text"))).withColumn(prefix + "copies", F.when(some, col("passes") + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(1).cast("int"))
    return rows.drop(*[prefix + x for x in ("source", "passes", "end_block", "end_key")])


def realised(mixed: DataFrame, columns: list[str], prefix: str = "mix_") -> DataFrame:
    """The mix itself: each document as often as mix_copies says, with these columns."""
    copies = F.col(prefix + "copies")
    return mixed.filter(copies > 0).withColumn(prefix + "copy", F.explode(F.sequence(F.lit(1), copies))).select(*columns)


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "mix_tokens", "mix_alpha", "mix_weight", "mix_quota", "mix_copies")
