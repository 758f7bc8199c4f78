"""Language identification by a string kernel.

A text is the set of its byte n-grams, n = 1 to 3 (the blended spectrum, presence only); two texts' kernel is the
number of n-grams they share over the geometric mean of their numbers. One-versus-rest kernel ridge regression is
fitted in the Nystroem approximation on landmarks. As the kernel is an inner product of presence vectors, landmarks and
coefficients fold into one matrix (n-grams x languages), and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.llm.common import small_batches
from keyspan.llm.tokens import PIECE, releasing, text_buffers

#: Different texts of each language that a model is fitted on: those with the smallest hashes.
SAMPLE = 250
#: Texts of all languages together that it is fitted on; with many languages each has fewer, but one at least.
SAMPLE_IN_ALL = 2000
#: Landmarks, spread evenly over the sample.
LANDMARKS = 256
RIDGE = 1e-4
UNKNOWN = "und"
#: Places of 1-, 2- and 3-grams. Two- and three-grams are hashed.
_N1, _N2, _N3 = 128, 1 << 12, 1 << 14
WIDTH = _N1 + _N2 + _N3
#: Letters of ASCII without case; other ASCII is one class; each byte of other letters keeps six bits.
_CLASS = np.zeros(256, dtype=np.uint32)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128) & 63) + 32 * (np.arange(128) >= 64)


class Model(NamedTuple):
    languages: tuple[str, ...]
    matrix: np.ndarray  # WIDTH x languages


def mark(row: np.ndarray, text: np.ndarray) -> None:
    """Sets row (WIDTH bytes) at the n-grams of a text's bytes, in pieces."""
    for at in range(0, len(text), PIECE):
        one = _CLASS[text[max(0, at - 2) : at + PIECE]]
        row[one] = 1
        two = (one[:-1] << np.uint32(7)) | one[1:]
        row[_N1 + ((two * np.uint32(2654435761)) >> np.uint32(20))] = 1
        three = (two[:-1] << np.uint32(7)) | one[2:]
        row[_N1 + _N2 + ((three * np.uint32(2654435761)) >> np.uint32(18))] = 1


def has_letter(text: np.ndarray) -> bool:
    known = _CLASS[text]
    if ((known > 0) & (known < 27)).any():
        return True
    return bool((text >= 128).any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram places of whole sampled texts and of a short and a middling passage of each."""
    for batch in batches:
        offsets, data = text_buffers(batch.column("text"))
        langs, out = batch.column("lang").to_pylist(), []
        for r, lang in enumerate(langs):
            text = data[offsets[r] : offsets[r + 1]]
            if not has_letter(text):
                continue
            start = int(len(text) * 0.38)
            for part in (text, text[start : start + 40], text[start : start + 240]):
                row = np.zeros(WIDTH, dtype=np.uint8)
                mark(row, part)
                out.append((lang, np.flatnonzero(row).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x.tolist() for _, x in out], pa.list_(pa.int32()))], names=["lang", "places"])


def fit(spark: SparkSession, labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from labelled (text, lang); rows without either are left out. Every language of any row is learned.

    Of each language the `sample` different texts with the smallest hashes are used (SAMPLE_IN_ALL together, but one of
    each), however often they are there and under whatever ids: the model depends on the rows alone, not on their order.
    Only their n-gram places come to the driver.
    """
    small_batches(spark)
    rows = labelled.filter("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit("sample"), "text").alias("h"))
    texts = {x["lang"]: x["n"] for x in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    languages = tuple(sorted(texts))
    if not languages:
        return Model((), np.zeros((WIDTH, 0), np.float32))
    sample = max(1, min(sample, SAMPLE_IN_ALL // len(languages)))
    # about three times the sample is below the bound, so that the smallest hashes are among it
    bounds = [int(min(1.0, 3 * max(sample, 20) / max(1, texts[lang])) * (1 << 40)) for lang in languages]
    bound = spark.createDataFrame(pa.table({"lang": pa.array(languages, pa.string()), "bound": pa.array(bounds, pa.int64())}))
    below = rows.join(F.broadcast(bound), "lang").filter(F.pmod("h", F.lit(1 << 40)) <= F.col("bound")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    chosen = below.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))).filter(F.col("nth") <= sample)
    found = chosen.select("text", "lang").mapInArrow(releasing(_features), "lang string, places array<int>").toArrow()
    found = list(zip(found["lang"].to_pylist(), (x.values.to_numpy() for x in found["places"]), strict=True))
    found.sort(key=lambda x: (x[0], x[1].tobytes()))  # the order that rows arrive in must not matter
    if not found:
        return Model(languages, np.zeros((WIDTH, len(languages)), np.float32))

    def vectors(rows) -> np.ndarray:
        out = np.zeros((len(rows), WIDTH), dtype=np.float32)
        for i, (_, places) in enumerate(rows):
            out[i, places] = 1 / np.sqrt(len(places))
        return out

    step = max(1, len(found) // landmarks)
    marks = vectors(found[::step][:landmarks])
    kmm = (marks @ marks.T).astype(np.float64)
    normal, target = np.zeros_like(kmm), np.zeros((len(marks), len(languages)))
    for at in range(0, len(found), 256):
        part = found[at : at + 256]
        k = (vectors(part) @ marks.T).astype(np.float64)
        y = np.array([[1.0 if own == lang else -1.0 for lang in languages] for own, _ in part])
        normal += k.T @ k
        target += k.T @ y
    alpha = np.linalg.solve(normal + ridge * len(found) * (kmm + 1e-8 * np.eye(len(marks))), target)
    return Model(languages, (marks.T @ alpha).astype(np.float32))


def score(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text: the score is the winner's regression value, from [-1, 1] to [0, 1]."""
    offsets, data = text_buffers(texts)
    n, names, scores = len(offsets) - 1, [], []
    for at in range(0, n, 64):
        rows = np.zeros((min(64, n - at), WIDTH), dtype=np.uint8)
        ok = np.zeros(len(rows), dtype=bool)
        for i in range(len(rows)):
            text = data[offsets[at + i] : offsets[at + i + 1]]
            ok[i] = bool(model.languages) and has_letter(text)
            if ok[i]:
                mark(rows[i], text)
        values = rows.astype(np.float32) @ model.matrix if model.languages else np.zeros((len(rows), 1))
        values = values / np.sqrt(np.maximum(1, rows.sum(axis=1, dtype=np.int64)))[:, None]
        best = values.argmax(axis=1)
        names += [model.languages[b] if k else UNKNOWN for b, k in zip(best, ok, strict=True)]
        scores.append(np.where(ok, np.clip((values.max(axis=1) + 1) / 2, 0, 1), 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def identify(docs: DataFrame, model: Model, pred: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """docs (text, any others) with the predicted language and its score; columns of these two names are replaced.

    Whole texts are looked at. A null text, or one without a letter, is `und` with score 0; if nothing was learned, every
    text is. Repeated rows each get theirs; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(pred, score_as)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score_as, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score(model, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(releasing(run), schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(spark: SparkSession, docs: DataFrame) -> Model:
    return fit(spark, docs.filter(~held_out()))


def op3_string_kernel_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), learned(spark, docs)).drop("text")
