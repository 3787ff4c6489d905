"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large star: each node's larger neighbours point to the least node around it; small
    star: its smaller neighbours and itself do. Only a minimum by node is aggregated and joined
    back, so no neighbourhood is held in one place; the edges of a hub pass through one task where AQE
    does not split them."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    seen = both.join(least, "u")
    if large:
        out = seen.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges``, component the least node reachable. Nodes
    are of any kind that has an order, such as a struct that begins with what a component is named by.

    Edges with a null end and self-loops link nothing; repeated edges count once. Each round is
    written to the shared folder, so its plan does not grow; rounds grow with the logarithm of the
    longest path. It ends when a round changes nothing.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    now, was = stored(pairs, "edges"), None
    while True:
        now = stored(_stars(_stars(now, True), False), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        was = mark


class Forest:
    """Keeps, of the pairs it is given, those that connect something new: fewer than there are nodes."""

    def __init__(self, nodes: int):
        self.root = np.arange(nodes)
        self.edges: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Drops all pairs that are together, joins one pair for each of the roots that are left, and
        so on: few rounds of array work even where almost all pairs are within one group."""
        root = self.root
        while len(i):
            while not np.array_equal(flat := root[root], root):
                root[:] = flat
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            _, once = np.unique(np.maximum(root[i], root[j]), return_index=True)
            for x, y in zip(i[once].tolist(), j[once].tolist()):
                p, q = self._find(x), self._find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    self.edges.append((x, y))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        found = np.asarray(self.edges, "i8").reshape(-1, 2)
        return found[:, 0], found[:, 1]
