import zlib

import numpy as np
import pytest

from keyspan.llm import sharding as S
from tests.llm.helpers import EDGE_TEXTS


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 24, 25, 1000, 4097, 70_000])
def test_a_permutation_and_its_inverse(n):
    rows = np.arange(n)
    p = S.permute(rows, n, seed=3)
    assert sorted(p.tolist()) == list(range(n))
    assert (S.permute(p, n, seed=3, back=True) == rows).all()
    for row in rows[:: max(1, n // 7)].tolist():
        assert S.row_at(*S.locate(row, n, 24, 3), n, 24, 3) == row


def test_seeds_differ_and_neighbours_part():
    p = S.permute(np.arange(10_000), 10_000)
    assert (p != S.permute(np.arange(10_000), 10_000, seed=1)).mean() > 0.99
    assert abs(np.corrcoef(np.arange(10_000), p)[0, 1]) < 0.05


def test_rows_law(spark):
    texts = [*EDGE_TEXTS, *EDGE_TEXTS, *(f"text {i}" for i in range(500))]
    rows = [(i * 7 % 509, t, "x", 5) for i, t in enumerate(texts)] + [(None, "null id", "x", 5), (3, "again", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, law string, at int").repartition(5)
    got = S.shard_rows(spark, df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    # the same whatever the partitions, and as locate() says
    key = lambda rs: sorted((r["doc_id"] or -1, r["text_crc32"], r["shard"], r["slot"]) for r in rs)
    assert key(got) == key(S.shard_rows(spark, df.repartition(3)).collect())
    order = sorted(((-1 if i is None else i, zlib.crc32((t or "").encode()), size(t)) for i, t, *_ in rows))
    placed = {(-1 if r["doc_id"] is None else r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got}
    assert {(i, c, *S.locate(n, len(rows))) for n, (i, c, _) in enumerate(order)} == placed


def test_few_rows(spark):
    assert S.shard_rows(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.shard_rows(spark, spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["slot"] == 0
