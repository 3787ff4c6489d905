"""Where intermediate tables go, and small helpers that several operators use."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import scratch_folder as new_folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: it cuts the lineage, and a
    lost executor costs a reread instead of the work above it."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet."""
    name = wanted
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of up to ``most`` bytes of a text column, and one row beyond: what
    is made of them as Python objects stays bounded, but for a single long text."""
    sizes = batch.column(column).nbytes if batch.num_rows else 0
    if sizes <= most:
        if batch.num_rows:
            yield batch
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8"))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)) + 1
        yield batch.slice(lo, hi - lo)
        lo = hi


def one_thread() -> None:
    """Spark deals the tasks; libraries inside them use one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def block_pairs(n: Column, p: Column) -> Column:
    """For a row in part ``p`` of ``n``: the units (pa, pb, side) in which it meets every part, itself
    in one with equal ends. Parts of equal size make units of bounded size, whatever the group's."""

    def unit(q):
        return F.struct(F.least(q, p).alias("pa"), F.greatest(q, p).alias("pb"), F.when(q < p, 1).otherwise(0).alias("side"))

    return F.transform(F.sequence(F.lit(0), n - 1), unit)


def join_told(rows: DataFrame, told: DataFrame, keys: list[str], copies: str, share: int = 1000) -> DataFrame:
    """``rows`` with what ``told`` says of their keys, in one row a key; its column ``copies`` is the
    number of rows a key has. Keys with more than a ``share``-th of all rows are fewer than ``share``:
    they are broadcast, so that the rows of a hot key are not gathered; the others meet by a shuffle."""
    total = told.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) * share > total
    many, few = F.broadcast(told.filter(hot).drop(copies)), told.filter(~hot).drop(copies)
    return rows.join(many, keys).unionByName(rows.join(many.select(*keys), keys, "left_anti").join(few, keys))
