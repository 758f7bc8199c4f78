"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees.

Vectors are unit directions in double precision; cosine >= c is a chord of at most sqrt(2 - 2c), a metric. Equal
vectors of a label are one point with a multiplicity. The points of each label are a tree of cells: a cell of more points
than a block is dealt among centres of its own, and each of those again, so the tree grows with the label and every leaf
is a block. Pairs of cells are walked down together from the root, level by level: a pair goes on to its children's pairs
only while the distance of the centres less both covering radii is within the threshold. Each pair of leaves that is left
is one unit of work: it builds a cover tree of either block (nested levels whose radii halve) and walks the two in the same way,
taking a pair of nodes whole when centre distance plus both radii is within the threshold. A unit returns numbers of links
and a spanning set of its links, both linear in its points: pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyspan.llm.common import stage
from keyspan.llm.components import components, smallest_reachable

#: Points of a block, and the most centres among which a larger cell is dealt.
BLOCK, FAN = 1024, 32
#: A child's number is its parent's times BASE and its place from 1; there are so many levels that numbers stay in a long.
BASE, LEVELS = 64, 9
#: Points that are dealt by one task call, and cells up to which a table of them is sent to all tasks.
CHUNK, SMALL = 4096, 200_000
#: Slack of bounds in double precision; pairs within it are decided by their own cosine.
EPS = 1e-9


class CoverTree:
    """Nested levels over unit vectors: level l's nodes are l-th-radius-separated points that cover all points.

    points are kept in farthest-first order, so the nodes of a level are a prefix of them.
    """

    def __init__(self, x: np.ndarray, finest: float):
        n = len(x)
        order, gap = np.zeros(n, dtype=np.int64), np.zeros(n)
        near = 2 - 2 * (x @ x[0])  # squared chords; bounds below use radii measured from the points themselves
        gap[0], m = np.inf, 1
        while m < n and near.max() > finest * finest:
            pick = int(near.argmax())
            order[m], gap[m] = pick, np.sqrt(near[pick])
            np.minimum(near, 2 - 2 * (x @ x[pick]), out=near)
            m += 1
        rest = np.setdiff1d(np.arange(n), order[:m])
        self.order = np.concatenate([order[:m], rest])
        self.x = x[self.order]
        # radii halve from the root's down to the finest; a last level has each point for itself
        radius, sizes = 2.0, [1]
        while radius > finest:
            radius /= 2
            if (size := int((gap[:m] > radius).sum())) > sizes[-1]:
                sizes.append(size)
        if sizes[-1] < n:
            sizes.append(n)
        self.sizes = sizes
        self.parents = [np.zeros(1, dtype=np.int64)]
        for above, size in zip(sizes, sizes[1:], strict=False):
            parent = (self.x[:size] @ self.x[:above].T).argmax(axis=1)
            parent[:above] = np.arange(above)  # levels are nested
            self.parents.append(parent)
        self.radii, self.homes, self.children = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
        home = np.arange(n)
        for level in range(len(sizes) - 1, -1, -1):
            if level < len(sizes) - 1:
                home = self.parents[level + 1][home]
            far = np.zeros(sizes[level])
            np.maximum.at(far, home, np.linalg.norm(self.x - self.x[home], axis=1))
            self.radii[level] = far
            self.homes[level] = home.copy()
        for level in range(1, len(sizes)):
            by = np.argsort(self.parents[level], kind="stable")
            starts = np.searchsorted(self.parents[level][by], np.arange(sizes[level - 1] + 1))
            self.children[level] = (by, starts)

    def expand(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, child at level + 1) for all children."""
        by, starts = self.children[level + 1]
        n = starts[nodes + 1] - starts[nodes]
        which = np.repeat(np.arange(len(nodes)), n)
        return which, by[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + starts[nodes][which]]


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    if len(i) * 8 > len(a) * len(b):
        return (a @ b.T)[i, j]
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 15):
        out[at : at + (1 << 15)] = np.einsum("ij,ij->i", a[i[at : at + (1 << 15)]], b[j[at : at + (1 << 15)]])
    return out


def dual_join(one: CoverTree, two: CoverTree, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Yields linked points as (nodes of one, nodes of two, level of one, level of two), in tree order.

    With levels given, all points below the nodes are linked; without, the two points are. same: one is two, and each
    pair comes once.
    """
    reach = np.sqrt(2 - 2 * least)
    la = lb = 0
    i, j = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while len(i):
        dot = _dots(one.x[: one.sizes[la]], two.x[: two.sizes[lb]], i, j)
        leaf_a, leaf_b = la == len(one.sizes) - 1, lb == len(two.sizes) - 1
        if leaf_a and leaf_b:
            ok = (dot >= least) & ((i < j) if same else True)
            yield i[ok], j[ok], None, None
            return
        dist = np.sqrt(np.maximum(0, 2 - 2 * dot))
        radii = one.radii[la][i] + two.radii[lb][j]
        whole = dist + radii <= reach - EPS
        if whole.any():
            yield i[whole], j[whole], la, lb
        go = (dist - radii <= reach + EPS) & ~whole
        i, j = i[go], j[go]
        own = (i == j) if same else None
        if not leaf_a:
            which, i = one.expand(la, i)
            j, la = j[which], la + 1
            own = own[which] if same else None
        if not leaf_b:
            which, j = two.expand(lb, j)
            i, lb = i[which], lb + 1
            own = own[which] if same else None
        if same:  # a node with itself makes each pair of its children twice; other pairs come once
            keep = ~own | (i <= j)
            i, j = np.minimum(i[keep], j[keep]), np.maximum(i[keep], j[keep])


def link_blocks(xa: np.ndarray, ma: np.ndarray, xb: np.ndarray | None, mb: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each point, smallest position it reaches) for the points of a, then those of b. xb None: a with itself.

    ma, mb: how many vectors a point stands for. Links of a point's own copies with each other are not counted here.
    """
    finest = np.sqrt(2 - 2 * least) / 4
    ta = CoverTree(xa, finest)
    same = xb is None
    tb, mb = (ta, ma) if same else (CoverTree(xb, finest), mb)
    shift = 0 if same else len(xa)
    n = len(xa) + (0 if same else len(xb))
    links, ps, qs = np.zeros(n, dtype=np.int64), [], []
    for i, j, level_a, level_b in dual_join(ta, tb, least, same):
        if level_a is None:
            p, q = ta.order[i], tb.order[j]
            links += np.bincount(p, weights=mb[q], minlength=n).astype(np.int64) + np.bincount(q + shift, weights=ma[p], minlength=n).astype(np.int64)
            ps.append(p)
            qs.append(q + shift)
            continue
        sums = []
        for tree, level, copies in ((ta, level_a, ma), (tb, level_b, mb)):
            sums.append(np.bincount(tree.homes[level], weights=copies[tree.order], minlength=tree.sizes[level]).astype(np.int64))
        two = ~((i == j) if same else np.zeros(len(i), dtype=bool))
        # what a node of one side gains from its partners, then handed to the points below it
        gain_a = np.bincount(i, weights=sums[1][j], minlength=ta.sizes[level_a]).astype(np.int64)
        gain_b = np.bincount(j[two], weights=sums[0][i[two]], minlength=tb.sizes[level_b]).astype(np.int64)
        links[ta.order] += gain_a[ta.homes[level_a]]
        links[tb.order + shift] += gain_b[tb.homes[level_b]]
        if same:
            alone = np.isin(ta.homes[level_a], i[~two])
            links[ta.order[alone]] -= ma[ta.order[alone]]
        # all points below two linked nodes hang together, through the nodes' own points
        for tree, level, nodes, add in ((ta, level_a, i, 0), (tb, level_b, j, shift)):
            below = np.isin(tree.homes[level], nodes)
            ps.append(tree.order[below] + add)
            qs.append(tree.order[tree.homes[level][below]] + add)
        ps.append(ta.order[i])
        qs.append(tb.order[j] + shift)
    none = np.zeros(0, dtype=np.int64)
    return links, smallest_reachable(n, np.concatenate([none, *ps]), np.concatenate([none, *qs]))


_POINT = "label string, d int, v array<double>, rep long, copies long, cell long, far double"
_KEYS = ["label", "d", "cell"]


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist())


def _deal(points: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Points of a part of a cell, each given to its nearest centre; far is its distance from it."""
    if not len(points) or not len(centres):
        return points.iloc[:0].drop(columns=["chunk"]).assign(far=0.0)
    x, c = _matrix(points["v"]), _matrix(centres["centre"])
    dots = x @ c.T
    pick = dots.argmax(axis=1)
    # measured on the difference, for 2 - 2 cos loses half the digits of small distances
    far = np.linalg.norm(x - c[pick], axis=1)
    return points.drop(columns=["chunk"]).assign(cell=centres["child"].to_numpy()[pick], far=far)


def split_cells(spark: SparkSession, points: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """(points (label, d, v, rep, copies, cell, far) in leaves, nodes (label, d, cell, centre, radius)): the tree of cells of each label.

    The root is 0 and has no node. Centres are the points with the smallest hashes, so cells are as dense as their points,
    whatever the order of rows. After LEVELS levels a cell stays as it is.
    """
    rows = points.select("label", "d", "v", "rep", "copies", F.lit(0).cast("long").alias("cell"), F.lit(2.0).alias("far"))
    nodes = None
    for level in range(LEVELS):
        big = stage(spark, rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "big-cells")
        if not (cells := big.count()):
            break
        near_big = F.broadcast(big) if cells <= SMALL else big
        inside = rows.join(near_big, _KEYS)
        fan = F.least(F.lit(FAN), F.ceil(2 * F.col("n") / block))
        hashed = inside.select(*_KEYS, "v", "n", F.pmod(F.xxhash64(F.lit(level), "rep"), F.lit(1 << 40)).alias("h"), "rep").filter(F.col("h") < (1 << 40) * 3 * F.greatest(fan, F.lit(16)) / F.col("n"))
        nth = F.row_number().over(W.partitionBy(*_KEYS).orderBy("h", "rep"))
        centres = stage(spark, hashed.withColumn("nth", nth).filter(F.col("nth") <= fan).select(*_KEYS, (F.col("cell") * BASE + F.col("nth")).alias("child"), F.col("v").alias("centre"), "n"), "centres")
        parts = F.ceil(F.col("n") / CHUNK)
        left = inside.withColumn("chunk", F.pmod(F.xxhash64("rep"), parts)).drop("n").groupBy(*_KEYS, "chunk")
        right = centres.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n").groupBy(*_KEYS, "chunk")
        dealt = stage(spark, left.cogroup(right).applyInPandas(_deal, _POINT), "dealt")
        radii = dealt.groupBy(*_KEYS).agg(F.max("far").alias("radius"))
        own = centres.select("label", "d", F.col("child").alias("cell"), "centre").join(radii, _KEYS)
        nodes = own if nodes is None else nodes.unionByName(own)
        rows = stage(spark, rows.join(near_big.select(*_KEYS), _KEYS, "left_anti").unionByName(dealt), "cells")
    return rows, None if nodes is None else stage(spark, nodes, "nodes")


def _near_cells(reach: float):
    """Keeps pairs (ca, ra, cb, rb) of cells whose balls come within reach of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ca, cb = (np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1) if len(set(batch.column(c).value_lengths().to_pylist())) == 1 else None for c in ("ca", "cb"))
            if ca is None or cb is None:  # labels of several lengths in one batch
                gap = np.array([np.linalg.norm(np.array(x) - np.array(y)) for x, y in zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist(), strict=True)])
            else:
                gap = np.linalg.norm(ca - cb, axis=1)
            keep = gap - batch.column("ra").to_numpy() - batch.column("rb").to_numpy() <= reach + EPS
            yield batch.select(["label", "d", "a", "b"]).filter(pa.array(keep))

    return run


def near_cells(spark: SparkSession, leaves: DataFrame, nodes: DataFrame | None, reach: float) -> DataFrame:
    """(label, d, a, b): pairs of leaves, each with itself and a < b of others, whose points may be within reach; leaves are (label, d, cell)."""
    roots = leaves.select("label", "d").distinct()
    pairs = roots.select("label", "d", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    if nodes is None:
        return pairs
    below = nodes.select("label", "d", (F.col("cell") - F.pmod("cell", F.lit(BASE))).alias("up"), "cell", "centre", "radius").withColumn("up", F.expr(f"up div {BASE}"))
    # a leaf is its own child, so that pairs whose sides end on different levels wait for each other
    ended = nodes.join(leaves.withColumn("leaf", F.lit(True)), _KEYS).select("label", "d", F.col("cell").alias("up"), "cell", "centre", "radius")
    down = stage(spark, below.unionByName(ended), "children")
    single = leaves.filter("cell = 0").select("label", "d", "cell")
    one = down.select("label", "d", F.col("up").alias("pa"), F.col("cell").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
    two = down.select("label", "d", F.col("up").alias("pb"), F.col("cell").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
    deepest = nodes.agg(F.max("cell")).first()[0]
    levels = 0
    while deepest:
        deepest, levels = deepest // BASE, levels + 1
    open_ = pairs.withColumnsRenamed({"a": "pa", "b": "pb"})
    for _ in range(levels):
        both = open_.join(one, ["label", "d", "pa"]).join(two, ["label", "d", "pb"]).filter("pa <> pb or a <= b")
        kept = stage(spark, both.select("label", "d", "a", "b", "ca", "ra", "cb", "rb").mapInArrow(_near_cells(reach), "label string, d int, a long, b long"), "cell-pairs")
        open_ = kept.withColumnsRenamed({"a": "pa", "b": "pb"})
    return open_.select("label", "d", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).unionByName(single.select("label", "d", F.col("cell").alias("a"), F.col("cell").alias("b")))


def near_vectors(spark: SparkSession, vectors: DataFrame, least: float = 0.93, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors (vec_id, embedding, label).

    Two vectors link when their labels are equal and not null and their cosine, in double precision, is at least
    `least`. A null or zero vector, one that holds null or a value that is not finite, or one of another length than
    its partner links with nothing. n_links counts the other rows linked directly; repeated rows count one by one, and
    rows that lead equal vectors under one vec_id are one node. component_id is the smallest vec_id reachable. A null
    vec_id links with nothing and is kept. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    # scaled by the largest value first, so that squares neither vanish nor overflow; -0.0 and 0.0 are one value
    rows = rows.withColumn("v", F.when(fine & (top > 0), F.transform("v", lambda x: x / top + 0.0)))
    rows = rows.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "k2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("second"), "v"))})
    # points: equal vectors of a label, told apart by 128 bits
    same = ["label", "k1", "k2"]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    points = rows.filter("v is not null").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).withColumn("norm", norm)
    points = stage(spark, points.select(*same, F.size("v").alias("d"), F.transform("v", lambda x: x / F.col("norm")).alias("v"), "rep", "copies"), "points")
    reach = float(np.sqrt(2 - 2 * least))
    placed, nodes = split_cells(spark, points, block)
    sizes = stage(spark, placed.groupBy(*_KEYS).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "leaves")
    pairs = near_cells(spark, sizes.select(*_KEYS), nodes, reach)
    # a leaf that levels could not make small enough is dealt into parts, which all meet
    of = lambda x: sizes.select("label", "d", F.col("cell").alias(x), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"{x}_part"))
    units = pairs.join(of("a"), ["label", "d", "a"]).join(of("b"), ["label", "d", "b"]).filter("a <> b or a_part <= b_part")
    units = stage(spark, units.select("label", "d", F.concat_ws("/", "a", "a_part").alias("b1"), F.concat_ws("/", "b", "b_part").alias("b2")), "block-pairs")
    placed = placed.join(sizes, _KEYS).withColumn("block", F.concat_ws("/", "cell", F.pmod(F.xxhash64("rep"), F.col("parts"))))
    sides = units.select("label", "d", "b1", "b2", F.col("b1").alias("block")).unionByName(units.filter("b1 <> b2").select("label", "d", "b1", "b2", F.col("b2").alias("block")))
    work = placed.select("label", "d", "block", "v", "rep", "copies").join(sides, ["label", "d", "block"])

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", kind="stable")
        a = part[part["block"] == part["b1"]]
        b = part[part["block"] != part["b1"]]
        (xa, ma, ra), (xb, mb, rb) = ((np.array(x["v"].tolist()), x["copies"].to_numpy(), x["rep"].to_numpy()) for x in (a, b))
        n, root = link_blocks(xa, ma, xb if len(b) else None, mb if len(b) else None, least)
        ids = np.concatenate([ra, rb])
        some = np.flatnonzero(n)
        return pd.DataFrame({"a": ids[some], "b": ids[root[some]], "n": n[some]}).astype("int64")

    found = stage(spark, work.groupBy("label", "d", "b1", "b2").applyInPandas(walk, "a long, b long, n long"), "walked")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    comps = components(spark, found.select("a", "b").distinct())
    nodes = points.groupBy("rep").agg(F.sum(F.col("copies") - 1).alias("own"))
    nodes = nodes.join(counts, "rep", "left").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    nodes = nodes.select("rep", (F.coalesce("others", F.lit(0)) + F.col("own")).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", *same).join(points.select(*same, "rep"), same, "left").join(nodes, "rep", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_cover_tree_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
), least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = node LEFT JOIN n ON vec_id = a
"""
