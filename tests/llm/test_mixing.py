import math
import random

import pytest
from pyspark.sql import functions as F

from keyspan.llm import mixing as M


def shares(tokens, target, most, budget):
    """(alpha, weights, quotas) by a fine search, in plain arithmetic."""
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items()}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    def repeats(a):
        w = weights(a)
        b = budget if budget is not None else max(tokens[s] / w[s] for s in w)
        return max(w[s] * b / tokens[s] for s in w)

    def search(ok, low):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) == low else (lo, mid)
        return lo if low else hi

    a1 = 1.0 if entropy(1.0) >= target * math.log(len(p)) - 1e-12 else search(lambda a: entropy(a) >= target * math.log(len(p)) - 1e-12, True)
    a2 = 0.0 if repeats(0.0) <= most + 1e-12 else search(lambda a: repeats(a) <= most + 1e-12, False)
    a = max(a1, a2)
    w = weights(a)
    b = budget if budget is not None else max(tokens[s] / w[s] for s in w)
    return a, w, {s: round(w[s] * b) for s in w}


def corpus(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, passes string"), rows


@pytest.mark.parametrize("target,most,budget", [(0.98, 2.0, None), (0.95, 10.0, None), (1.0, 3.0, 2500), (0.5, 1.0, 1000), (0.99, 50.0, 20_000)])
def test_weights_quotas_and_what_they_come_to(spark, target, most, budget):
    df, rows = corpus(spark, {"big": 200, "mid": 60, "small": 15, None: 10})
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    a, w, q = shares(tokens, target, most, budget)
    got = M.mix_sources(spark, df, target, most, budget).collect()
    assert len(got) == len(rows)
    for s in tokens:
        own = [r for r in got if r["source"] == s]
        assert abs(own[0]["mix_alpha"] - a) < 1e-9 and abs(own[0]["mix_weight"] - w[s]) < 1e-9 and abs(own[0]["mix_quota"] - q[s]) <= 1
        real = sum(r["mix_tokens"] * r["mix_copies"] for r in own)
        assert 0 <= own[0]["mix_quota"] - real < 30  # less than a document short
        assert max(r["mix_copies"] for r in own) - min(r["mix_copies"] for r in own) <= 1
        assert max(r["mix_copies"] for r in own) <= math.ceil(most) or a == 1
    if budget is None:
        assert min(r["mix_copies"] for r in got) >= 1


def test_the_front_of_the_permutation_is_taken(spark):
    df, _ = corpus(spark, {"a": 300, "b": 20})
    got = M.mix_sources(spark, df.withColumn("key", M._key(0)), 1.0, 3.0, 2000).filter("source = 'a'").orderBy("key").collect()
    copies = [r["mix_copies"] for r in got]
    assert copies == sorted(copies, reverse=True) and len(set(copies)) == 2


def test_realised(spark):
    df, rows = corpus(spark, {"a": 30, "b": 5})
    mixed = M.mix_sources(spark, df, 1.0, 2.0)
    out = M.realised(mixed, df.columns)
    assert out.columns == df.columns and out.count() == mixed.agg(F.sum("mix_copies")).first()[0]


def test_no_python_in_the_plan(spark):
    df, _ = corpus(spark, {"a": 30, "b": 5})
    plan = M.realised(M.mix_sources(spark, df), df.columns)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix_sources(spark, empty).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "y"), (3, "a b", "y"), (None, "c", None), (4, "w " * 5000, "y")], "doc_id long, text string, source string")
    got = M.mix_sources(spark, odd).collect()
    assert len(got) == 6 and all(r["mix_copies"] >= 1 for r in got)
    assert {r["mix_weight"] for r in got if r["source"] == "x"} == {None}
