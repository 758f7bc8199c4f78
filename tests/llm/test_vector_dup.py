import numpy as np
import pytest

from keyspan.llm import vector_dup as V
from keyspan.llm.components import smallest_reachable


def clustered(rng, n, d, noise):
    centres = rng.normal(size=(5, d))
    x = centres[rng.integers(0, 5, n)] + noise * rng.normal(size=(n, d))
    x[: n // 3] = rng.normal(size=(n // 3, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(12))
def test_dual_traversal_is_exact(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(2, 20))
    xa, xb = clustered(rng, int(rng.integers(1, 150)), d, float(rng.choice([0.01, 0.1, 0.3]))), clustered(rng, int(rng.integers(1, 150)), d, 0.1)
    xb[: len(xb) // 2] = xa[rng.integers(0, len(xa), len(xb) // 2)]
    ma, mb = rng.integers(1, 4, len(xa)), rng.integers(1, 4, len(xb))
    links, _ = V.link_blocks(xa, ma, xb, mb, 0.93)
    near = xa @ xb.T >= 0.93
    assert (links[: len(xa)] == near @ mb).all() and (links[len(xa) :] == near.T @ ma).all()
    links, root = V.link_blocks(xa, ma, None, None, 0.93)
    near = xa @ xa.T >= 0.93
    np.fill_diagonal(near, False)
    assert (links == near @ ma).all()
    assert (root == smallest_reachable(len(xa), *np.nonzero(near))).all()


def test_a_tree_covers_and_nests():
    x = clustered(np.random.default_rng(4), 200, 6, 0.2)
    t = V.CoverTree(x, 0.05)
    assert t.sizes == sorted(t.sizes) and t.sizes[-1] == len(x) and sorted(t.order.tolist()) == list(range(len(x)))
    for level, size in enumerate(t.sizes):
        far = np.linalg.norm(t.x - t.x[t.homes[level]], axis=1)
        assert (far <= t.radii[level][t.homes[level]] + 1e-12).all() and (t.homes[level][:size] == np.arange(size)).all()


def brute(rows, least=0.93):
    ok = [(i, np.array(v, float), lab) for i, (_, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and rows[i][0] is not None]
    n = {i: set() for i in range(len(rows))}
    for a, x, l in ok:
        for b, y, m in ok:
            if a != b and l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                n[a].add(b)
    return n


@pytest.mark.parametrize("block", [6, 1024])
def test_vectors(spark, block):
    rng = np.random.default_rng(8)
    x = clustered(rng, 90, 6, 0.08)
    rows = [(1000 - i, (x[i] * rng.uniform(0.1, 50)).astype(np.float32).tolist(), int(i % 3)) for i in range(90)]
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(5)]  # copies
    rows += [(3000, None, 1), (3001, [0.0] * 6, 1), (3002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (3003, [float("nan")] * 6, 1), (3004, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 1), (3005, [], 1), (3006, rows[0][1], None), (3007, [1.0, 2.0], 0), (3008, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<float>, label int, block string")
    got = {r["vec_id"]: r for r in V.near_vectors(spark, df, block=block).collect()}
    near = brute(rows)
    ids = [r[0] for r in rows]
    assert len(got) == len(rows)
    for i, v in enumerate(ids):
        reach, todo = {i}, [i]
        while todo:
            todo = [b for a in todo for b in near[a] if b not in reach and not reach.add(b)]
        smallest = min(ids[j] for j in reach)
        assert (got[v]["n_links"], got[v]["component_id"], got[v]["kept"]) == (len(near[i]), smallest, smallest == v)


def test_edges(spark):
    assert V.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, -0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in V.near_vectors(spark, df).collect())
    assert [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)] == got[1:] and got[0][0] == 0 and got[0][3]
