"""Embedding whitening from an incremental eigendecomposition.

Entries are read as integers (64ths, moved to be positive), so that sums are exact. Every partition keeps
the spectrum of its vectors by centred rank-one updates (``spectrum``); spectra are joined, sixteen at a
time, by further rank-one updates. The basis this gives is refined by one Rayleigh-Ritz step over all
vectors: their covariance is measured in the basis, centred with the exact sums before multiplying, and
its small eigenproblem turns the basis into the components. What goes to the driver or from task to task
is of the size of the dimension squared, whatever the number of vectors.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import stored
from .shared import one_thread
from .spectrum import EPS, Spectrum

#: Steps of an entry, what moves it, components given, and partial results that one task joins.
STEPS, MOVE, COMPONENTS, FAN = 64, 1_000_000, 32, 16
#: Entries beyond are taken as this far: integers stay exact in doubles.
FAR = float(1 << 52)


def vectors_of(batch: pa.RecordBatch, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and integers, less ``MOVE``, of the vectors of a batch that have ``dim`` entries, all finite."""
    rows = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False))
    x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    good = np.isfinite(x).all(1)
    with np.errstate(over="ignore"):
        return rows.column(0).filter(pa.array(good)), np.clip(np.floor(STEPS * x[good]), -FAR, FAR).astype("i8")


class Centre:
    """Number and exact sums of all vectors, and how a vector lies to their mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.near = np.asarray([s // n for s in sums], "i8")
        self.rest = np.asarray([s % n for s in sums], "i8")

    def off(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sums over dimensions of ``(n * x - sum) ** 2``; null beyond a long."""
        if not len(x):
            return pa.array([], pa.int64())
        rough = ((self.off(x) * float(self.n)) ** 2).sum(1)
        exact = self.n * (x - self.near) - self.rest
        fits = rough < 9.2e18
        return pa.array((exact * exact).sum(1), pa.int64(), mask=~fits)


def per_task(rows: DataFrame, dim: int, start: Callable[[], Any], add: Callable[[Any, np.ndarray], None]) -> DataFrame:
    """Rows ``(at, state)``, one for each partition: what ``add`` makes of its batches."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        state = start()
        for b in batches:
            _, x = vectors_of(b, dim)
            if len(x):
                add(state, x)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["at", "state"])

    return rows.mapInArrow(tasks, "at bigint, state binary")


def joined(parts: DataFrame, join: Callable[[Any, Any], Any], label: str) -> Any:
    """All states in one, ``FAN`` at a time, in as many rounds as their number needs. They are written
    first, so that a round that is repeated does not repeat the work below it."""
    parts = stored(parts, label)
    most = parts.agg(F.max("at")).first()[0]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        states = [pickle.loads(s) for s in group.sort_values("at")["state"]]
        total = states[0]
        for state in states[1:]:
            total = join(total, state)
        return pd.DataFrame({"at": [int(group["at"].min()) // FAN], "state": [pickle.dumps(total)]})

    while most is not None and most > 0:
        parts = parts.groupBy(F.floor(F.col("at") / FAN)).applyInPandas(merge, "at bigint, state binary")
        most //= FAN
    last = parts.first()
    return pickle.loads(last.state) if last else None


def _spectrum(rows: DataFrame, dim: int) -> tuple[int, list[int], Spectrum]:
    """Number and exact sums of all integers, and their spectrum as joined from all partitions."""

    def start() -> list:
        return [[0] * dim, Spectrum.empty(dim)]

    def add(state: list, x: np.ndarray) -> None:
        # halves of 32 bits cannot overflow within a batch
        state[0] = [a + int(h) * 2**32 + int(s) for a, h, s in zip(state[0], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
        # equal vectors of a batch are one update
        same, copies = np.unique(x, axis=0, return_counts=True)
        for row, n in zip(same.astype(float), copies.tolist()):
            state[1].add(row, n)

    def join(a: list, b: list) -> list:
        large, small = (a[1], b[1]) if a[1].n >= b[1].n else (b[1], a[1])
        large.join(small)
        return [[x + y for x, y in zip(a[0], b[0])], large]

    sums, made = joined(per_task(rows, dim, start, add), join, "spectra") or start()
    return made.n, sums, made


def _scatter(rows: DataFrame, dim: int, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """Covariance of all vectors in a basis, centred before multiplying."""

    def start() -> list:
        return [np.zeros((basis.shape[1],) * 2), np.zeros(basis.shape[1])]

    def add(state: list, x: np.ndarray) -> None:
        y = centre.off(x) @ basis
        state[0] += y.T @ y
        state[1] += y.sum(0)

    total, sums = joined(per_task(rows, dim, start, add), lambda a, b: [a[0] + b[0], a[1] + b[1]], "scatter")
    mean = sums / centre.n
    return total / centre.n - np.outer(mean, mean)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows ``(vec_id, component, n, deviation, whitened, explained, identity_error)``: one for each vector
    and component.

    Vectors that are null or hold null or non-finite entries take no part. An entry c becomes
    floor(64 c) + 1,000,000. Components are eigenvectors of the covariance of these integers (divisor n), by
    falling eigenvalue; ``whitened`` is the centred vector on a component over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of the trace, ``identity_error`` the largest entry of the whitened
    covariance less the identity, measured over all vectors. ``deviation`` is exact; it is null where it
    is beyond a long.

    Components whose eigenvalue is zero, as far as doubles tell, have no whitened values and are left out,
    so a table of one vector, or of equal ones, gives no rows. Vectors of another length than most (ties:
    the smaller; none: no rows) take no part. Entries beyond 2**46 count as such. Repeated rows and repeated
    or null ids are vectors of their own; of equal eigenvalues any basis may come. An empty table gives no
    rows; other columns are not read. Five passes over the vectors, no shuffle of them.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sizes = rows.filter((F.size("v") > 0) & finite).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return df.sparkSession.createDataFrame([], schema)
    dim = most.dim
    n, sums, made = _spectrum(rows, dim)
    centre = Centre(n, sums)
    basis, _ = np.linalg.qr(made.vectors)
    # Rayleigh-Ritz
    values, turn = np.linalg.eigh(_scatter(rows, dim, centre, basis))
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    kept = int((values > max(values[0], 0) * 4 * dim * EPS).sum()) if values[0] > 0 else 0
    k = min(components, kept)
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    white = axes[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(_scatter(rows, dim, centre, white) - np.eye(k)).max())
    explained = values[:k] / values.sum()

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            ids, x = vectors_of(b, dim)
            repeat = np.repeat(np.arange(len(x)), k)
            z = centre.off(x) @ white
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(x))), pa.array(np.full(len(repeat), n)), centre.deviation(x).take(pa.array(repeat)),
                 pa.array(z.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(repeat), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(tasks, schema)
