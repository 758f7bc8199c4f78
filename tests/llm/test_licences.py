import random
from collections import Counter

from keyspan.llm import licences as C
from tests.llm.helpers import EDGE_TEXTS, prose


def words(text):
    out = "".join(c.lower() if ord(c) > 127 or c.isalnum() else " " for c in text or "").split()
    return [C._ONE_SPELLING.get(w, w) for w in out]


def grams(ws):
    return Counter(zip(ws, ws[1:], strict=False))


def best(template, text, least):
    """The highest Dice coefficient of any run of words."""
    t, ws, top = grams(words(template)), words(text), 0.0
    for i in range(len(ws)):
        for j in range(i + 2, min(len(ws), i + 2 * sum(t.values()) + 3) + 1):
            g = grams(ws[i:j])
            top = max(top, 2 * sum((g & t).values()) / (sum(g.values()) + sum(t.values())))
    return top if top >= least else 0.0


def test_against_all_runs(spark):
    rng = random.Random(4)
    templates = (("MIT", "Released under the MIT License."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC", "Licensed under CC BY-NC 4.0."))
    docs = list(EDGE_TEXTS[:10])
    for _, text in templates:
        ws = text.split()
        docs += [text, f"{prose(rng, 30)}\n{text.upper()}\n{prose(rng, 30)}", " ".join(ws[:-1]), " ".join(ws[: len(ws) // 2]), " ".join([ws[0], "oddly", *ws[1:]]), text.replace("icense", "icence"), f"{text} {prose(rng, 5)} {text}"]
    docs += [prose(rng, 60) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], r["licence"]): r["dice"] for r in C.scan_licences(df, templates).collect()}
    want = {(i, name): d for i, text in enumerate(docs) for name, t in templates if (d := best(t, text, 0.8))}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_the_best_of_templates_that_resemble_each_other(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY-SA 4.0. And more words here to follow. Released under the MIT License."), (1, None), (None, "released under the mit licence")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["licence"], r["first_word"], r["n_words"]) for r in C.scan_licences(df).collect())
    assert got == [(0, "MIT", 0, 5), (1, "CC-BY-SA-4.0", 0, 7), (1, "MIT", 13, 5)]
    assert C.scan_licences(df.limit(0)).count() == 0


def test_no_hits_in_a_whole_batch(spark):
    assert C.scan_licences(spark.createDataFrame([(1, "ka lo mi"), (2, "tu")], "doc_id long, text string")).count() == 0


def test_a_licence_is_found_at_its_own_place_beside_a_sibling(spark):
    gpl3, gpl2 = (f"This work is licensed under the GNU General Public License, version {v}." for v in (3, 2))
    between = prose(random.Random(6), 30)
    docs = [
        f"{gpl3} {between} {gpl2.replace('Public', 'Open')}",  # the best run of 2 alone is the notice of 3
        f"{gpl3} {between} {gpl2.removeprefix('This ')}",  # a tie with it
        f"{gpl3} {between} {gpl3}",
        f"{gpl3.replace('work', 'thing')} {between} {gpl3} {between} {gpl2.replace('work', 'thing')}",
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["licence"], r["first_word"], r["n_words"]) for r in C.scan_licences(df).collect())
    assert got == [(0, "GPL-2.0", 42, 12), (0, "GPL-3.0", 0, 12), (1, "GPL-2.0", 42, 11), (1, "GPL-3.0", 0, 12), (2, "GPL-3.0", 0, 12), (3, "GPL-2.0", 86, 10), (3, "GPL-3.0", 42, 12)]


def test_whole_licence_texts_are_found_where_they_stand(spark):
    """The longest template of each licence, alone, between other words, and with every tenth word changed."""
    rng = random.Random(11)
    longest = {}
    for name, text in C.TEMPLATES:
        longest[name] = max(longest.get(name, ""), text, key=len)
    docs, want = [], {}
    for name, text in longest.items():
        for harmed in (False, True):
            ws = [w if not harmed or len(text.split()) < 40 or i % 25 != 7 else "harmed" for i, w in enumerate(text.split())]
            want[len(docs)] = name
            docs.append(f"{prose(rng, 20)} {' '.join(ws)} {prose(rng, 20)}")
    got = {}
    for r in C.scan_licences(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], {})[r["licence"]] = (r["dice"], r["first_word"])
    for i, name in want.items():
        assert name in got[i] and got[i][name][1] in range(18, 23), (i, name, got.get(i))
        assert max(got[i], key=lambda x: got[i][x][0]) == name
