import random

import numpy as np
import pyarrow as pa
import pytest

from keyspan.llm import near_dup as N
from keyspan.llm.components import components
from keyspan.llm.tokens import shingles, word_hashes
from tests.llm.helpers import EDGE_TEXTS, edited, groups, prose, shingle_set, words_of


def brute(texts, percent):
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, groups(len(texts), links)


def corpus():
    rng = random.Random(11)
    texts = list(EDGE_TEXTS) + [EDGE_TEXTS[6], EDGE_TEXTS[11]]
    for _ in range(12):
        base = prose(rng, rng.choice([8, 60, 200]))
        texts += [base, base.upper(), *[edited(rng, base, s) for s in (0.005, 0.01, 0.02, 0.05)]]
        chain = base
        for _ in range(4):  # neighbours are near, the ends are not
            chain = edited(rng, chain, 0.01)
            texts.append(chain)
    return texts + [prose(rng, 50) for _ in range(30)]


def test_links_and_components_are_exact(spark):
    texts = corpus()
    sets, roots = brute(texts, 85)
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, family string, n_shingles double")
    got = {r["doc_id"]: r for r in N.near_duplicates(spark, df).collect()}
    assert len(got) == len(texts) and len(set(roots)) < len(roots)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), roots[i], roots[i] == i), texts[i]


@pytest.mark.parametrize("small", [0, N.SMALL])
def test_blocks_of_a_large_family_miss_nothing(spark, monkeypatch, small):
    """The leader doesn't hold all, so blocks are compared; tables are joined or, if small, sent along."""
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "SMALL", small)
    rng = random.Random(3)
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04])) for _ in range(60)]
    _, roots = brute(texts, 85)
    got = N.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(roots))


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(spark, empty).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (7, None), (7, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(spark, df).collect())
    assert got == [(False, 2, 2, 2, True), (False, 5, 2, 2, False), (False, 5, 2, 2, False), (False, 7, 0, 7, True), (False, 7, 0, 7, True), (True, None, 2, None, True)]


def test_an_id_with_several_texts(spark):
    rng = random.Random(2)
    one, two, other = (prose(rng, 150) for _ in range(3))
    docs = [(5, one), (5, two), (5, two), (9, edited(rng, two, 0.01)), (3, edited(rng, one, 0.01)), (7, other)]
    got = {(r["doc_id"], r["component_id"]) for r in N.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7)}  # different texts named by one id share its node


def test_words_and_shingles():
    texts = corpus()
    seen = {}
    for first, _, bounds, hashes in word_hashes(pa.array(texts)):
        _, at = shingles(hashes, bounds)
        for r in range(len(bounds) - 1):
            own = hashes[bounds[r] : bounds[r + 1]]
            assert len(own) == len(words_of(texts[first + r]))
            for w, h in zip(words_of(texts[first + r]), own.tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    long = "ab " * 400_000 + "é" * 900_000 + " z"
    (_, _, bounds, hashes), = word_hashes(pa.array([long]))
    assert len(hashes) == 400_002 == bounds[-1] and len(set(hashes.tolist())) == 3


def test_the_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    off, dropped = [], 0
    with np.errstate(over="ignore"):
        for _ in range(200):
            common = rng.integers(0, 1 << 63, 850, dtype=np.uint64)
            a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 75, dtype=np.uint64)]) for _ in range(2))
            s = N.odd_sketch(np.array([N.min_samples(a), N.min_samples(b)]))
            bits = int(np.bitwise_count(s[0] ^ s[1]).sum())
            off.append(N.estimate(bits) - 0.85)
            dropped += bits > N.most_bits(85)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06 and dropped == 0


@pytest.mark.parametrize("n", [1, 30])
def test_components_of_a_path_and_a_star(spark, n):
    links = [(i, i + 1) for i in range(n)] + [(100, 100 + i) for i in range(n)] + [(300, 300)]
    got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[100 + i] == 100 for i in range(n)) and got[300] == 300
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
