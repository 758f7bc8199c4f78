"""Connected components of a link table, by contraction.

Each round points every node at its smallest neighbour, shortens the pointers by doubling, and relabels the
links by the roots. Every component that has a link left loses at least half its roots, so the rounds are
logarithmic. All steps are min-aggregates (combined before the shuffle) and equi-joins: a hub is never
gathered in one place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.common import drop, stage


def _roots(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node -> root of its tree when each node points at its smallest neighbour or itself. links hold both directions."""
    ptr = stage(spark, links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "pointers")
    while True:
        up = ptr.select(F.col("node").alias("root"), F.col("root").alias("next"))
        last, ptr = ptr, stage(spark, ptr.join(up, "root").select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")), "pointers")
        drop(last)
        if not ptr.filter("moved").limit(1).count():
            return ptr


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) for every node that occurs in links (a, b); component is the smallest node reachable.

    Repeated links, self links and both directions are allowed; links with a null end are ignored.
    An empty table of links gives an empty result.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null")
    both = stage(spark, links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = _roots(spark, both)
    while True:
        ends = label.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        other = label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = both.join(ends, "a").join(other, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        last, both = both, stage(spark, left, "links")
        drop(last)
        if not both.limit(1).count():
            return label.select("node", F.col("root").alias("component"))
        roots = _roots(spark, both)
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        last, label = label, stage(spark, label.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        drop(last, roots)


def smallest_reachable(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches by links (p, q)."""
    root = np.arange(n)
    while True:
        rp, rq = root[p], root[q]
        if (rp == rq).all():
            return root
        np.minimum.at(root, np.maximum(rp, rq), np.minimum(rp, rq))
        while (root != root[root]).any():
            root = root[root]
