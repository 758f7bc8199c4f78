import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from keyspan.llm import language_id as L
from tests.llm.helpers import EDGE_TEXTS

PARTS = {"aa": ("tha", "ing", "wor", "nd"), "bb": ("sch", "ein", "über", "keit"), "cc": ("qué", "ión", "lla", "osa")}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(spark, n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        rows.append((i, text(rng, lang, rng.choice([3, 20, 200])), lang if i % 17 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    got = L.identify(docs.withColumn("held_out", L.held_out()), L.learned(spark, docs)).collect()
    kept = [r for r in got if r["held_out"]]
    assert len(got) == 400 and 40 < len(kept) < 130
    assert np.mean([r["lang_pred"] == r["truth"] for r in kept]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def places(data: bytes) -> set[int]:
    """Where a text's 1- to 3-grams lie, one by one."""
    kind = lambda b: b + 1 - 97 if 97 <= b <= 122 else b + 1 - 65 if 65 <= b <= 90 else 0 if b < 128 else 27 + (b & 63) + (32 if b >= 192 else 0)
    k, out = [kind(b) for b in data], set()
    for i, x in enumerate(k):
        out.add(x)
        if i > 0:
            out.add(128 + (((k[i - 1] << 7 | x) * 2654435761 % (1 << 32)) >> 20))
        if i > 1:
            out.add(128 + 4096 + ((((k[i - 2] << 7 | k[i - 1]) << 7 | x) * 2654435761 % (1 << 32)) >> 18))
    return out


def test_against_kernel_ridge_regression_in_plain_terms(spark):
    """With every sample a landmark the approximation is exact: (K + n r I)^-1 y, with the kernel counted from sets."""
    rng = random.Random(9)
    docs = [(text(rng, lang, rng.choice([4, 40])), lang) for lang in PARTS for _ in range(6)]
    df = spark.createDataFrame([*docs, *docs[:4], (None, "aa"), ("12", "bb"), ("some", None)], "text string, lang string")
    model = L.fit(spark, df, landmarks=1000, ridge=0.01)
    assert model.languages == tuple(sorted(PARTS))
    samples = []
    for t, lang in docs:
        data = t.encode()
        start = int(len(data) * 0.38)
        samples += [(places(x), lang) for x in (data, data[start : start + 40], data[start : start + 240])]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b, _ in samples] for a, _ in samples])
    tests = [text(rng, lang, 8) for lang in PARTS for _ in range(4)] + ["Other words, 17 of them", "é", "ÀÉ"]
    rows = np.array([[kernel(places(t.encode()), b) for b, _ in samples] for t in tests])
    names, scores = L.score(model, pa.array(tests))
    values = np.stack([rows @ np.linalg.solve(k + 0.01 * len(samples) * np.eye(len(samples)), [1.0 if x == lang else -1.0 for _, x in samples]) for lang in model.languages], axis=1)
    assert names == [model.languages[i] for i in values.argmax(axis=1)]
    assert np.allclose(scores, np.clip((values.max(axis=1) + 1) / 2, 0, 1), atol=2e-3)


def test_a_model_depends_on_the_rows_alone(spark):
    docs = corpus(spark, 300)
    one = L.fit(spark, docs, sample=15)
    # other order, other ids, many copies of some rows
    two = L.fit(spark, docs.withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.filter("doc_id < 30")).orderBy(F.desc("text")).repartition(5), sample=15)
    assert one.languages == two.languages and np.array_equal(one.matrix, two.matrix)


def test_as_many_languages_as_there_are(spark):
    rng = random.Random(4)
    rows = [(" ".join(chr(0x100 + i) * 3 + rng.choice("abc") for _ in range(12)), f"l{i:03}") for i in range(230) for _ in range(3)]
    model = L.fit(spark, spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 230 and L.score(model, pa.array([rows[0][0], rows[-1][0]]))[0] == ["l000", "l229"]


def test_edges(spark):
    model = L.learned(spark, corpus(spark, 150))
    edge = spark.createDataFrame([(i, t, 7) for i, t in enumerate([*EDGE_TEXTS, "12 34 !!", "дом", "…"])], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in L.identify(edge, model).collect()}
    n = len(EDGE_TEXTS)
    assert len(got) == n + 3
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 8, n, n + 2))
    assert got[3]["lang_pred"] in PARTS and got[n + 1]["lang_pred"] in PARTS
    nothing = L.learned(spark, spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in L.identify(edge, nothing).collect()} == {"und"}
    assert L.identify(edge.limit(0), model).count() == 0


def test_long_texts_are_marked_whole():
    row, again = np.zeros(L.WIDTH, np.uint8), np.zeros(L.WIDTH, np.uint8)
    data = np.frombuffer(("ab cde " * 200_000 + "xyz").encode(), np.uint8)
    L.mark(row, data)
    L.mark(again, np.frombuffer(("ab cde " * 3 + "xyz").encode(), np.uint8))
    assert (row == again).all()
