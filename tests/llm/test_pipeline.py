import random
from collections import Counter

import corpus_pipeline as P
from keyspan.llm import language_id as L
from tests.llm.helpers import edited, groups, prose, shingle_set
from tests.llm.test_language_id import text as foreign


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(12)
    docs = []
    for i in range(60):
        lang = rng.choice(("aa", "bb", "cc"))
        docs.append((i, foreign(rng, lang, 60), lang, "hot" if i % 3 == 0 else f"s{i % 5}", 0))
    docs += [(100 + i, edited(rng, docs[i][1], 0.01), docs[i][2], "hot", 0) for i in range(8)]
    # near copies at 0.80 to 0.85: two words changed far apart in 90 shingles or so
    base = foreign(rng, "bb", 100).split()
    docs += [(140, " ".join(base), "bb", "s3", 0), (141, " ".join([*base[:30], "schein", *base[31:70], "keitein", *base[71:]]), "bb", "s3", 0)]
    docs += [(120, docs[0][1], "aa", "s1", 0)]
    items = [(i, prose(rng, 20)) for i in range(4)]
    docs += [(200 + i, f"{foreign(rng, 'aa', 20)} {t} {foreign(rng, 'aa', 20)}", "aa", "s2", 0) for i, t in items]
    docs += [(300, None, "aa", "s1", 0), (301, "12 34", "bb", "s1", 0), (302, "", None, None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    df, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, step) in enumerate(P.STAGES):
        df = step(spark, df, str(tmp_path))
        if name != "sharding":
            assert df.columns == columns
            df.write.parquet(str(tmp_path / f"stage{k}"))
            df = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append(sorted(r["doc_id"] for r in df.collect()))
    assert kept[0] == sorted(d[0] for d in docs if d[0] < 300)
    left = [d for d in docs if d[0] in set(kept[0])]
    sets = [shingle_set(d[1]) for d in left]
    roots = groups(len(left), [(i, j) for i in range(len(left)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    assert kept[1] == sorted(left[i][0] for i in range(len(left)) if roots[i] == i) and len(kept[1]) < len(kept[0])
    assert kept[2] == [i for i in kept[1] if i < 200]
    assert set(kept[3]) == set(kept[2]) and max(Counter(kept[3]).values()) <= 2
    assert kept[4] == kept[3]
    last = P.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in last) == kept[4]
    sizes = Counter(r["shard"] for r in last)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
    assert L.UNKNOWN == "und" and P.ORACLE_SQL is None


def test_texts_that_no_language_claims_are_dropped(spark):
    rng = random.Random(5)
    docs = [(i, foreign(rng, lang, 60), lang) for i in range(240) for lang in [("aa", "bb", "cc")[i % 3]]]
    polish = "Miasto leży nad brzegiem rzeki, a jego mieszkańcy pracują w pobliskich fabrykach, gdzie produkują buty i meble sprzedawane w całym kraju."
    russian = "Город находится на берегу реки, и жители работают на соседних фабриках, где производят обувь и мебель."
    junk = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(30))
    odd = [(1000, polish, None), (1001, russian, None), (1002, junk, None)]
    short = [(1003, "zx.", None)]  # too short to be judged
    df = spark.createDataFrame(docs + odd + short, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in P.identify_language(spark, df, "").collect()) == [*range(240), 1003]


def test_rows_are_judged_and_not_ids(spark, tmp_path):
    rng = random.Random(8)
    one, two, clean, item = (prose(rng, 40) for _ in range(4))
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, one), (1, one), (2, one), (None, one), (None, two), (None, two), (3, clean), (3, one)], schema)
    got = sorted(((r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, one), (None, two), (3, clean)], key=str)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, f"{one} {item}"), (1, clean), (None, f"{two} {item}"), (None, two), (2, None)], schema)
    got = sorted(((r["doc_id"], r["text"]) for r in P.decontaminate_documents(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, clean), (None, two), (2, None)], key=str)


def test_edges_of_every_stage(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, an empty table."""
    rng = random.Random(3)
    spark.createDataFrame([(0, prose(rng, 20)), (1, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, score int, hash string, mix_source string, mix_copies int, `group` int, __pred string"
    own = lambda i, text, lang="aa", source="s": (i, text, lang, source, i, "r", 7, "h", "m", 9, 1, "mine")
    rows = [own(i, foreign(rng, "aa" if i % 2 else "bb", 30), "aa" if i % 2 else "bb") for i in range(40)]
    odd = [own(None, foreign(rng, "aa", 30), None, None), own(60, None), own(61, ""), own(62, "word " * 50_000), own(63, "x" * 300_000), rows[3], rows[3], (None,) * 12]
    docs = spark.createDataFrame(rows + odd, schema)
    kept = {name: 0 for name, _ in P.STAGES}
    for name, step in P.STAGES:
        out = step(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns and out.schema == docs.schema
        kept[name] = out.count()
        empty = step(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == out.columns
    found = P.identify_language(spark, docs, str(tmp_path)).collect()
    assert {r["__pred"] for r in found} == {"mine"} and not {60, 61} & {r["doc_id"] for r in found}
    assert sum(r["doc_id"] == 3 for r in found) == 3
    assert kept["near_dedup"] == len(rows + odd) - 2  # only the repeated rows are copies
    assert kept["decontamination"] == kept["sharding"] == len(rows + odd) and kept["mixing"] >= len(rows + odd)
