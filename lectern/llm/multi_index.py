"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised by codebooks of their own; a pair of centroids is a cell.
A query visits cells by the sum of its distances to their two centroids, from a heap, until the
cells visited hold the wanted part of the entries, and reranks those by their distance in double
precision. The cells it visits are those up to one summed distance, so that distance is all that is
sent with a query to the blocks of entries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .near_vectors import matrix, usable
from .shared import stored

#: Rows that codebooks and the visited part are fitted on, the queries among them that fit the part,
#: and the share of their neighbours that it must reach.
SAMPLE, TRIALS, WANTED = 8192, 512, 0.96
#: Entries, and queries, that meet in one task: a 64th of the entries within these bounds.
LEAST_BLOCK, MOST_BLOCK = 1024, 16384
#: The fewest and the most centroids of a half; between them as many as give cells of so many entries,
#: and never more than so many rows of the sample can place.
FEWEST_CENTROIDS, MOST_CENTROIDS, CELL = 128, 256, 8


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T


@dataclass
class MultiIndex:
    """Codebooks of the halves, and the part of the entries that a query visits."""

    left: np.ndarray
    right: np.ndarray
    part: float = 1.0

    @property
    def dim(self) -> int:
        return self.left.shape[1] + self.right.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        return _squares(x[:, :h], self.left), _squares(x[:, h:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def visit(self, a: np.ndarray, b: np.ndarray, entries: np.ndarray, wanted: float) -> Iterator[tuple[int, float]]:
        """Cells with entries, and their summed distance, in the order of it, until they hold ``wanted``
        entries: a heap over the two sorted lists, where a pair follows once both pairs before it have
        been taken."""
        p, q = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        heap, reached, held = [(a[p[0]] + b[q[0]], 0, 0)], [0] * len(p), 0
        while heap and held < wanted:
            far, i, j = heapq.heappop(heap)
            reached[i] = j + 1
            cell = p[i] * len(q) + q[j]
            if entries[cell]:
                yield cell, far
                held += entries[cell]
            if i + 1 < len(p) and reached[i + 1] >= j:
                heapq.heappush(heap, (a[p[i + 1]] + b[q[j]], i + 1, j))
            if j + 1 < len(q) and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (a[p[i]] + b[q[j + 1]], i, j + 1))

    def reach(self, a: np.ndarray, b: np.ndarray, entries: np.ndarray, wanted: float) -> float:
        """The summed distance of the last cell that a query visits."""
        far = 0.0
        for _, far in self.visit(a, b, entries, wanted):
            pass
        return far


def fit(sample: np.ndarray, rows: int, k: int = 10, wanted: float = WANTED, seed: int = 5) -> MultiIndex:
    """Codebooks from ``sample``; the visited part is what reaches the ``k`` nearest of trial queries
    within the sample (where neighbours are farther off than among all rows, so it errs on more)."""
    centroids = min(max(FEWEST_CENTROIDS, round((rows / CELL) ** 0.5)), MOST_CENTROIDS, max(len(sample) // CELL, 1))
    h = (sample.shape[1] + 1) // 2
    index = MultiIndex(_kmeans(sample[:, :h], centroids, seed), _kmeans(sample[:, h:], centroids, seed + 1))
    trials = sample[np.random.default_rng(seed).choice(len(sample), min(TRIALS, len(sample)), replace=False)]
    cells = index.cells(sample)
    entries = np.bincount(cells, minlength=centroids**2)
    a, b = index.distances(trials)
    needed = []
    for x, y, near in zip(a, b, _squares(trials, sample)):
        sums = (x[:, None] + y[None, :]).ravel()
        order = np.argsort(sums, kind="stable")
        before = np.zeros(len(order))
        before[order] = np.cumsum(entries[order])
        closest = np.argsort(near, kind="stable")[1 : k + 1]
        needed += before[cells[closest]].tolist()
    index.part = float(np.quantile(needed, wanted)) / len(sample) if needed else 1.0
    return index


def _nearest(k: int, index: MultiIndex):
    """The ``k`` nearest entries of a unit for each of its queries, among the cells that it visits."""
    kinds = {"q": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}

    def of(queries: pa.Table, entries: pa.Table) -> pa.Table:
        if not len(queries) or not len(entries):
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        cell = entries.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        q, e = matrix(queries.column("embedding"), index.dim), matrix(entries.column("embedding"), index.dim)[order]
        row, reach = queries.column("q").to_numpy(), queries.column("reach").to_numpy()
        qid, eid = queries.column("query_id").to_numpy(), entries.column("vec_id").to_numpy()[order]
        cells, starts = np.unique(cell[order], return_index=True)
        ends = np.append(starts[1:], len(e))
        left, right = cells // len(index.right), cells % len(index.right)
        out = []
        for lo in range(0, len(q), 256):
            part = q[lo : lo + 256]
            a, b = index.distances(part)
            visits = (a[:, left] + b[:, right] <= reach[lo : lo + 256, None]).T
            rough = np.full((len(part), len(e)), np.inf)
            for of_cell, start, end in zip(visits, starts.tolist(), ends.tolist()):
                who = np.flatnonzero(of_cell)
                if len(who):
                    rough[who, start:end] = _squares(part[who], e[start:end])
            rough[qid[lo : lo + 256, None] == eid[None, :]] = np.inf
            last = np.partition(rough, min(k, len(e)) - 1, axis=1)[:, min(k, len(e)) - 1]
            slack = 1e-9 * (1 + (part**2).sum(1) + (e**2).sum(1).max())
            for i in range(len(rough)):
                near = np.flatnonzero((rough[i] <= last[i] + slack[i]) & np.isfinite(rough[i]))
                score = np.sqrt(((part[i] - e[near]) ** 2).sum(1))
                best = np.lexsort((eid[near], score))[:k]
                out.append((np.full(len(best), row[lo + i]), np.full(len(best), qid[lo + i]), eid[near][best], score[best]))
        return pa.table({n: pa.array(np.concatenate(c), t) for (n, t), c in zip(kinds.items(), zip(*out))})

    return of


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, index: MultiIndex | None = None, block: int | None = None) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` the
    ``k`` nearest of the entries visited, by Euclidean distance in double precision, nearest first,
    ties to the smaller id; all candidates where there are fewer.

    All rows are entries. Null, empty and zero vectors, those with null or non-finite components or
    of another length than most, and null ids take no part; a query's own row (its id) is no
    candidate. Repeated rows are entries of their own; a query id that stands twice is one query for
    each. No rows give no rows; other columns are not read.

    Codebooks are fitted on ``SAMPLE`` rows (those of the smallest hashes); tables of one row for
    each cell, at most ``MOST_CENTROIDS`` squared, are all else that the driver sees. Neighbouring cells
    make blocks of entries, and a cell larger than a block is dealt over several, so no cell is
    gathered; a query is sent to the blocks with a cell that it visits.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.filter(usable("embedding") & F.col("vec_id").isNotNull())
    dims = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    dim, total = dims[0]["dim"], dims[0]["count"]
    rows = rows.filter(F.size("embedding") == dim)
    if index is None:
        chosen = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE).toArrow()
        index = fit(matrix(chosen.column("embedding"), dim), total, k)

    def assign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.cells(matrix(b.column(1), dim)).astype("i4"))], names=["vec_id", "embedding", "cell"])

    entries = stored(rows.mapInArrow(assign, "vec_id bigint, embedding array<double>, cell int"), "entries")
    held = np.zeros(len(index.left) * len(index.right), "i8")
    for r in entries.groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]
    wanted = min(total, max(index.part * total, 20 * k))
    block = block or min(max(total // 64, LEAST_BLOCK), MOST_BLOCK)
    # cells in order, laid end to end in blocks
    ends = np.cumsum(held)
    first = (ends - held) // block
    blocks = np.maximum((ends - 1) // block - first, 0) + 1
    occupied = np.flatnonzero(held)
    by_cell = spark.createDataFrame(pa.table({"cell": pa.array(occupied.astype("i4")), "first": pa.array(first[occupied]), "blocks": pa.array(blocks[occupied])}))
    left_of, right_of, last_of = occupied // len(index.right), occupied % len(index.right), (first + blocks - 1)[occupied]

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            vectors = matrix(b.column(2), index.dim)
            x, y = index.distances(vectors)
            # and what another order of sums may add
            reach = np.asarray([index.reach(a, c, held, wanted) for a, c in zip(x, y)]) + 1e-9 * (1 + (vectors**2).sum(1))
            met = []
            for a, c, r in zip(x, y, reach):
                near = a[left_of] + c[right_of] <= r
                met.append(np.unique(np.concatenate([np.arange(f, t + 1) for f, t in zip(first[occupied][near], last_of[near])] if block < held.max() else [first[occupied][near], last_of[near]])))
            of = np.repeat(np.arange(b.num_rows), [len(v) for v in met])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of)) for c in b.columns), pa.array(reach[of]), pa.array(np.concatenate(met).astype("i8"))], names=["q", "query_id", "embedding", "reach", "block"])

    queries = entries.filter(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "embedding").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    probes = queries.mapInArrow(probe, "q bigint, query_id bigint, embedding array<double>, reach double, block bigint")
    # queries of a block in parts of a block's size: as many parts for every block, so that both sides know
    parts = max(-(-(total // every) // block), 1)
    key = ["block", "part"]
    left = probes.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)))
    at = F.col("first") + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("blocks"))
    right = entries.join(F.broadcast(by_cell), "cell").select(at.alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), "vec_id", "embedding", "cell")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_nearest(k, index), "q bigint, query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
