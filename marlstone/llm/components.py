"""Connected components of a graph given as edges, by alternating star rounds over DataFrames.

Each round sends minima along edges (large star, then small star); the number of rounds grows with the logarithm of
the longest path. Each round is written to the shared folder, so no lineage piles up and a lost executor costs one
round at most. A node with very many edges is met by partial aggregation, and by a join whose sides are both read from
tables: Spark can split a hot key of such a join, but not of one that shares its exchange with an aggregation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that edges lead to. Order is that of long."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    now = materialise(now, "edges", few_files=True)
    mark = _mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        stars = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars", few_files=True)
        large = both.filter("b > a").join(stars, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        old = now
        now = materialise(small.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", few_files=True)
        before, mark = mark, _mark(now)
        discard(old, stars)
        if mark == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """A digest of a bag of edges: equal edges, equal digests; 128 bits tell others apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(7)))).first())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the edges, within one task."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]
