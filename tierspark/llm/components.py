"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspark.llm.common import stored


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for edges between the nodes 0 to n - 1."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        changed = root.copy()
        np.minimum.at(changed, root[a], least)
        np.minimum.at(changed, root[b], least)
        while True:
            jumped = changed[changed]
            if np.array_equal(jumped, changed):
                break
            changed = jumped
        if np.array_equal(changed, root):
            return root
        root = changed


def forest(pairs: np.ndarray) -> np.ndarray:
    """Stars with the same components as ``pairs``: each node but the smallest is tied to the smallest."""
    nodes, places = np.unique(pairs, return_inverse=True)
    if not len(nodes):
        return np.zeros((0, 2), pairs.dtype)
    places = places.reshape(-1, 2)
    root = _roots(places[:, 0], places[:, 1], len(nodes))
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[tied], nodes[root[tied]]], axis=1)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has an edge in ``edges(a, b)``; the root is the smallest node reachable.

    Each round ties every node to the smallest neighbour of its neighbourhood and is written to the shared
    folder. A node's neighbours are never gathered: the smallest is an aggregate, and the node is replaced by
    it in each edge on its own. Rounds grow with the logarithm of the longest path.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        # Large star: neighbours above a node are tied to its smallest neighbour, or itself.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        tied = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        lower = tied.where("a <> b").distinct()
        bottom = lower.groupBy("a").agg(F.min("b").alias("m"))
        moved = lower.join(bottom, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = stored(bottom.select("a", F.col("m").alias("b")).unionByName(moved).distinct(), "edges")
        # Done when every node has one edge, to a node that has none of its own.
        roots = after.select(F.col("b").alias("a")).distinct()
        if after.groupBy("a").count().where("count > 1").isEmpty() and after.join(roots, "a", "left_semi").isEmpty():
            break
        now = after
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
