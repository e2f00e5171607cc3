"""Connected components of a graph given as links, as Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.session import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the links ``(a, b)``: the least node of its component.

    Each round links every node to the least node of its neighbourhood, first for larger neighbours, then
    for smaller ones, until nothing changes: every tree has become a star, after a number of rounds that
    grows with the logarithm of the longest path. Only minima are gathered, never a node's neighbours, and
    each round is a table in the shared folder, so a lost executor costs no earlier round. The minima are
    written before they are joined: Spark may then split the rows of a node with many neighbours.
    """
    pairs = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        # larger neighbours of a node go to the least node around it
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "links")
        wide = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        wide = written(wide.distinct(), "links")
        # a node's smaller neighbours, and the node itself, go to the least of them
        least = written(wide.groupBy("a").agg(F.min("b").alias("m")), "links")
        near = wide.join(least, "a")
        near = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        pairs = written(near.distinct(), "links")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state


def joined_roots(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that join two trees, which they make one; ``root`` is changed."""

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    apart = root[left] != root[right]
    kept = []
    for a, b in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    pairs = np.array(kept, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]
