"""Embedding near-duplicates by collision-counting projections.

Vectors are projected on many random lines; on every line the values are sorted and each vector
opens a window around its own value. For vectors at cosine c the difference on a line is normal with
variance 2-2c, so a pair at the threshold falls into a window with a known chance, and the number of
lines on which it does is binomial. The least number of collisions that such a pair reaches but for
``MISS`` is the count that candidates must pass; those are verified by their cosine. Lines and
windows are calibrated for all pairs at the threshold or closer, whatever the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import Forest, components
from .shared import block_pairs, join_told, stored

#: Lines, half-width of a window in standard deviations of a pair at the threshold, and the chance
#: to miss such a pair.
LINES, HALF_WIDTH, MISS = 64, 1.0, 1e-7
#: Vectors of a block; larger labels are dealt as pairs of blocks.
BLOCK = 1024
#: Labels whose sizes are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def needed_count(lines: int = LINES, half_width: float = HALF_WIDTH, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches with a chance of at least 1 - miss."""
    p = math.erf(half_width / math.sqrt(2))
    below = 0.0
    for count in range(lines + 1):
        below += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if below > miss:
            return count
    return lines


def project(units: np.ndarray, lines: int = LINES, seed: int = 3) -> np.ndarray:
    return units @ np.random.default_rng(seed).standard_normal((units.shape[1], lines))


def colliding(queries: np.ndarray, base: np.ndarray, half: float, least: int) -> np.ndarray:
    """Bits (query, base vector): whether the base vector lies in the query's window on at least
    ``least`` lines.

    On a sorted line a window is a stretch, so its members are the difference of two prefixes, kept
    as bit sets; the sets of all lines are counted in bit-sliced counters, 64 base vectors a word.
    """
    words = -(-len(base) // 64)
    bit = np.left_shift(np.uint64(1), np.arange(len(base), dtype="u8") % np.uint64(64))
    planes = [np.zeros((len(queries), words), "u8") for _ in range(queries.shape[1].bit_length())]
    for q, b in zip(queries.T, base.T):
        order = np.argsort(b, kind="stable")
        line = b[order]
        prefix = np.zeros((len(base) + 1, words), "u8")
        prefix[np.arange(1, len(base) + 1), order // 64] = bit[order]
        np.bitwise_xor.accumulate(prefix, axis=0, out=prefix)
        carry = prefix[np.searchsorted(line, q + half, "right")] ^ prefix[np.searchsorted(line, q - half, "left")]
        for plane in planes:
            both = plane & carry
            plane ^= carry
            carry = both
    above, equal = np.zeros_like(planes[0]), np.full_like(planes[0], ~np.uint64(0))
    for k in reversed(range(len(planes))):
        if least >> k & 1:
            equal &= planes[k]
        else:
            above |= equal & planes[k]
            equal &= ~planes[k]
    return np.unpackbits((above | equal).astype("<u8").view("u1"), axis=1, count=len(base), bitorder="little").view(bool)


def block_links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine of at least ``threshold``, found by collisions and verified in double
    precision; within ``a`` (each pair once) or between ``a`` and ``b``."""
    other = a if b is None else b
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, other)]
    lines = [project(u) for u in unit]
    half, least = HALF_WIDTH * math.sqrt(2 - 2 * threshold), needed_count()
    found = []
    for lo in range(0, len(a), 1024):
        i, j = np.nonzero(colliding(lines[0][lo : lo + 1024], lines[1], half, least))
        i = i + lo
        if b is None:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 16):
            x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            near = np.einsum("ij,ij->i", a[x], other[y]) / np.sqrt(np.einsum("ij,ij->i", a[x], a[x]) * np.einsum("ij,ij->i", other[y], other[y])) >= threshold
            found.append((x[near], y[near]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, "i8"), np.zeros(0, "i8"))


def usable(vector: str) -> F.Column:
    """Not null, empty or zero, and without null or non-finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as an array of doubles."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)


def _unit_links(threshold: float):
    """For the rows of a unit (a pair of blocks of one label): the copies that each node links with
    here, and a spanning forest of the links."""

    def of(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        side, node, copies = (rows.column(c).to_numpy() for c in ("side", "node", "copies"))
        x = matrix(rows.column("embedding"), dim)
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if rows.column("pa")[0].as_py() != rows.column("pb")[0].as_py() else None
        i, j = block_links(x[one], None if two is None else x[two], threshold)
        i, j = one[i], (one if two is None else two)[j]
        links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        forest = Forest(len(node))
        forest.add(i, j)
        a, b = forest.ends()
        has = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([node[has], node[a]])),
            "b": pa.array(np.concatenate([node[has], node[b]])),
            "links": pa.array(np.concatenate([links[has], np.zeros(len(a))]).astype("i8")),
        })

    return of


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, block: int = BLOCK, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Rows ``(vec_id, n_links, component_id, kept)``, one for each row of ``vectors``.

    Vectors link when their labels and lengths are equal, the labels not null, and their cosine in
    double precision is at least ``threshold``. n_links counts the other rows linked directly,
    component_id is the smallest vec_id reachable. Equal vectors of a label stand for one node with a
    number of copies, so copies are counted and not compared. Vectors that are null, empty, zero or
    hold null or non-finite components, rows with a null label and rows with a null vec_id link with
    nothing: n_links 0, component_id their own vec_id (kept is false for a null one). Repeated rows
    and repeated vec_ids are rows of their own; an empty table gives none; other columns are not read.

    Labels larger than ``block`` are dealt as pairs of blocks, so a hot label is spread over tasks;
    a unit returns counts and a forest, never its pairs. The work of a label grows with the square of
    its distinct vectors, at a few machine words for 64 of them.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    # 128 bits stand for a label and vector where rows meet their node again, so that no vector is sent
    rows = rows.withColumn("k1", F.xxhash64("label", "embedding")).withColumn("k2", F.xxhash64(F.lit(3), "embedding", "label"))
    rows = rows.withColumn("usable", usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    nodes = rows.filter("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("k1").alias("k1"), F.any_value("k2").alias("k2"))
    nodes = stored(nodes.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    placed = nodes.join(F.broadcast(sizes) if sizes.count() <= most_broadcast else sizes, ["label", "dim"]).withColumn("p", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    units = placed.select("label", "dim", "node", "copies", "embedding", F.explode(block_pairs(F.col("n"), F.col("p"))).alias("c")).select("label", "dim", "c.pa", "c.pb", "c.side", "node", "copies", "embedding")
    found = stored(units.groupBy("label", "dim", "pa", "pb").applyInArrow(_unit_links(threshold), "a bigint, b bigint, links bigint"), "links")
    counts = found.filter("links > 0").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    # nodes by their least id, so that a component is named without being gathered
    end = lambda e: nodes.select(F.col("node").alias(e), F.struct("least", "node").alias(f"mark_{e}"))
    groups = components(found.filter("links = 0").select("a", "b").join(end("a"), "a").join(end("b"), "b"), "mark_a", "mark_b")
    groups = groups.select(F.col("node.node").alias("node"), F.col("component.least").alias("component_id"))
    told = nodes.select("node", "k1", "k2", "least", "copies").join(counts, "node", "left").join(groups, "node", "left")
    told = stored(told.select("k1", "k2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "told")
    linked = join_told(rows.filter("usable").select("vec_id", "k1", "k2"), told, ["k1", "k2"], "copies").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
