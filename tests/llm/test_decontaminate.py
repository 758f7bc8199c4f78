import random

import numpy as np
import pyarrow as pa
import pytest

from keyspan.llm import decontaminate as D
from tests.llm.helpers import EDGE_TEXTS, prose


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_parallel_search():
    rng = random.Random(1)
    for _ in range(300):
        p = [rng.randint(0, 4) for _ in range(rng.randint(1, 70))]
        t = [rng.randint(0, 4) for _ in range(rng.randint(0, 90))]
        assert D.best_match(D.pattern_masks(p), len(p), t)[0] == edit_distance(p, t)


def spoil(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.choice("sid")
        if kind == "s":
            words[at] = "zz" + str(rng.randint(0, 99))
        elif kind == "i":
            words.insert(at, "yy" + str(rng.randint(0, 99)))
        elif len(words) > 1:
            del words[at]
    return words


def case():
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 3, 5, 8, 12, 14, 20, 36, 59, 59])] + [(90, None), (91, "..."), (7, None)]
    docs = [(1000 + i, t) for i, t in enumerate(EDGE_TEXTS)]
    for i, text in items[4:10]:
        words = text.split()
        for edits in (0, 1, len(words) // 10, len(words) // 5, len(words) // 5 + 2, len(words) // 2):
            docs.append((len(docs), f"{prose(rng, 40)} {', '.join(w.upper() for w in spoil(rng, words, edits))} {prose(rng, 40)}"))
    docs += [(len(docs) + i, prose(rng, 150)) for i in range(20)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.find_leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    split = lambda t: "".join(c.lower() if ord(c) > 127 or c.isalnum() else " " for c in t or "").split()
    want = {}
    for item_id, text in items:
        p = split(text)
        for doc_id, body in docs:
            if p and (d := edit_distance(p, split(body))) <= D.allowed(len(p), 80):
                want[doc_id, item_id] = d
    found = {k for k in want if k in got}
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in found)
    assert all(got[k] == d for k, d in want.items() if d == 0)
    assert len(found) >= 0.97 * len(want)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x A, b! c d e f y")], "doc_id long, text string"), spark.createDataFrame([(5, "A b c d e f")], "item_id long, text string")
    assert D.find_leaks(spark, none[0], some[1]).count() == D.find_leaks(spark, some[0], none[1]).count() == 0
    got = sorted((r["doc_id"] or 0, r["item_id"], r["edits"], r["end_word"]) for r in D.find_leaks(spark, *some).collect())
    assert got == [(0, 5, 0, 7), (1, 5, 0, 6), (1, 5, 0, 6)]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_BYTES", 200)
    docs, items = case()
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((r["doc_id"], r["item_id"], r["edits"]) for r in D.find_leaks(spark, *frames).collect())
    several = rows()
    monkeypatch.setattr(D, "ITEM_BYTES", 8 << 20)
    exact = lambda rs: [r for r in rs if r[2] == 0]
    assert exact(several) == exact(rows())


@pytest.mark.parametrize("words,edits", [(1, 0), (4, 0), (5, 1), (36, 7)])
def test_allowed(words, edits):
    assert D.allowed(words, 80) == edits


@pytest.mark.parametrize("even", [True, False])
@pytest.mark.parametrize("words", [5, 10, 12, 15, 20, 30, 60])
def test_recall_with_all_permitted_edits(words, even):
    """Repetitions follow from the target recall: short items with all their edits, even evenly spread, are found as well."""
    rng = random.Random(words)
    known = [f"w{i}" for i in range(2000)]
    items = [[rng.choice(known) for _ in range(words)] for _ in range(150)]
    index = D.build_index([(i, " ".join(x)) for i, x in enumerate(items)], 80)
    edits, hits = D.allowed(words, 80), 0
    assert len({p.salt for p in index.probes}) == -(-D.repeats(words, 80) // 4)
    for i, item in enumerate(items):
        places = {int((e + 0.5) * words / edits) for e in range(edits)} if even else set(rng.sample(range(words), edits))
        harmed = [y for at, x in enumerate(item) for y in ([x] if at not in places else rng.choice([["zz"], [], [x, "yy"]]))]
        text = [rng.choice(known) for _ in range(9)] + harmed + [rng.choice(known) for _ in range(9)]
        with np.errstate(over="ignore"):
            hashes = next(D.word_hashes(pa.array([" ".join(text)]), D.PUNCTUATION))[3]
            hits += any(found[1] == i for found in D._search(index, {}, hashes, np.array([0, len(hashes)])))
    assert hits >= 0.97 * len(items)
