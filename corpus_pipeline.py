"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns documents with
the columns it got, whatever they are called; the last returns the shard and slot of each row. run() applies them one after
another, each stage's result being written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm import decontaminate, language_id, mixing, near_dup, sharding
from keyspan.llm.common import stage, unused

#: A document whose best language scores less than this is rejected: no classifier clearly claims it (0.5 is undecided).
LEAST_SCORE = 0.53
#: The share of held-out labelled documents that may score less than the least score; it is lowered until that holds.
LOST = 0.001
#: Likeness from which texts are near copies, and hold a benchmark item.
PERCENT = 80
#: Texts of fewer characters say too little to be denied a language.
SHORT = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those of SHORT characters or more that no language claims.

    A document is claimed by a score of LEAST_SCORE, or of the lowest LOST of held-out labelled documents if that is
    less. The classifiers' values sum to about 2 - languages, so a model of one language claims almost all texts. Null
    and empty texts have no letter and go; where no row has both a text and a language, nothing is learned and all go.
    Rows are judged by their text alone: repeated rows stay or go together. An empty table gives an empty result.
    """
    model = language_id.learned(spark, docs)
    columns, pred, score = docs.columns, unused(docs.columns, "pred"), unused(docs.columns, "score")
    long = F.length("text") >= SHORT
    sure = language_id.identify(docs.filter(language_id.held_out() & F.col("lang").isNotNull() & long).select("text"), model, pred, score)
    lowest = sure.filter(F.col(pred) != language_id.UNKNOWN).agg(F.percentile_approx(score, LOST, 100_000)).first()[0]
    least = LEAST_SCORE if lowest is None else min(LEAST_SCORE, lowest)
    found = language_id.identify(docs, model, pred, score)
    return found.filter((F.col(pred) != language_id.UNKNOWN) & (~long | (F.col(score) >= least))).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, the one with the smallest doc_id, of each group of near copies: PERCENT of their 5-word shingles alike.

    Rows are judged, not ids: of rows that share the smallest doc_id one stays, and a null doc_id comes after all others.
    Texts without words, and null ones, are no copies and stay. An empty table gives an empty result.
    """
    number = unused(docs.columns, "row")
    # written, so that a row keeps its number
    rows = stage(spark, docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = near_dup.near_duplicates(spark, rows.select(F.col(number).alias("doc_id"), "text"), percent=PERCENT, k=5)
    ids = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).join(rows.select(F.col(number).alias("row"), F.col("doc_id").alias("id")), "row")
    kept = ids.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")).select("first.row")
    gone = stage(spark, ids.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(number)), "copies")
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item, whatever their doc_id, and no others.

    Repeated rows stay or go together. Null and empty texts hold no item and stay, null and empty items are nowhere. An
    empty table, or no items, drops nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    text = unused(docs.columns, "hash")
    # a text's 64-bit hash stands for it
    gone = decontaminate.find_leaks(spark, docs.select(F.xxhash64("text").alias("doc_id"), "text"), items, percent=PERCENT).select(F.col("doc_id").alias(text)).distinct()
    return docs.withColumn(text, F.xxhash64("text")).join(stage(spark, gone, "leaks"), text, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, at most twice each, until the mix reaches its entropy; none is dropped.

    A null source is one of its own. Documents without words, or with a null text, are there once. Rows that repeat a
    doc_id are repeated alike. An empty table gives an empty result.
    """
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return mixing.realised(mixing.mix_sources(spark, docs, target_entropy=0.98, most_repeats=2.0, prefix=prefix), docs.columns, prefix)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix, as sharding.shard_rows says: repeated rows each get their place."""
    return sharding.shard_rows(spark, docs, shards=24, seed=0)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("mixing", mix),
    ("sharding", shard),
]

#: MinHash, random walks and Feistel rounds have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(spark, step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
