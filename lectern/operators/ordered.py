"""Running values by key, for keys of any number of rows.

A window holds the rows of a key in one task. Keys with more than ``LONG`` rows are therefore dealt in
stretches: their rows are range-partitioned by key and order and written with the number of their stretch;
each stretch tells in one row what later ones need (its count, sum, last values); a window over these few
rows carries it on; and the rows of a stretch get their values from a window over the stretch and from what
is carried into it. Other keys go through one window. Both give the same values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from ..sources.scratch import stored

#: Rows of a key that one window takes.
LONG = 1_000_000
STRETCH = "_stretch"


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys), F.lit(True))


def in_stretches(rows: DataFrame, keys: list[str], order: list[Column | str], stretches: int) -> DataFrame:
    """``rows`` with the number of their stretch, written once: a second range exchange would draw other
    bounds."""
    by = [*map(F.col, keys), *(F.col(o) if isinstance(o, str) else o for o in order)]
    return stored(rows.repartitionByRange(stretches, *by).withColumn(STRETCH, F.spark_partition_id()), "stretches")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    tell: Callable[[DataFrame, list[str]], DataFrame],
    carry: Callable[[DataFrame, WindowSpec], DataFrame],
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    long: int = LONG,
) -> DataFrame:
    """``add(rows, w)`` for all of ``df``, where ``w`` is a window by key and order.

    ``tell(rows, by)`` makes a row for each key and stretch (the columns ``by``); ``carry(told, w)`` gives
    these rows columns of what the stretches before tell, ``w`` being a window over a key's stretches.
    The new columns are on the rows that ``add`` gets, null where nothing is carried, and do not stay.
    No keys mean that all rows are one group. ``long`` rows of a key stay in one window; keys with more are
    at most the ``long``-th part of the rows, so their list is broadcast, and so is what is carried: a
    stretch begins within one key at most, so it is a row a stretch at most.
    """
    by = [*keys, STRETCH]
    told_of = lambda rows: carry(tell(rows, by), W.partitionBy(*keys).orderBy(STRETCH))
    shape = told_of(df.withColumn(STRETCH, F.lit(0)))
    names = [f for f in shape.schema if f.name not in by]

    def plain(rows: DataFrame) -> DataFrame:
        bare = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in names})
        return add(bare, W.partitionBy(*keys).orderBy(*order)).drop(*(f.name for f in names))

    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > long)
    large = sizes.agg(F.sum("_rows")).first()[0] or 0
    if not large:
        return plain(df)
    hot = df
    rest = None
    if keys:
        listed = stored(sizes.select(*keys), "long_keys")
        is_long = F.broadcast(listed).alias("r")
        hot, rest = df.alias("l").join(is_long, _same(keys), "left_semi"), df.alias("l").join(is_long, _same(keys), "left_anti")
    rows = in_stretches(hot, keys, order, -(-2 * large // max(long, 1)))
    carried = told_of(rows).select(*by, *(f.name for f in names))
    any_told = reduce(lambda a, b: a | b, (F.col(f.name).isNotNull() for f in names))
    met = rows.alias("l").join(F.broadcast(carried.filter(any_told)).alias("r"), _same(by), "left").select("l.*", *(f"r.{f.name}" for f in names))
    done = add(met, W.partitionBy(*by).orderBy(*order)).drop(STRETCH, *(f.name for f in names))
    return plain(rest).unionByName(done) if rest is not None else done


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str, long: int = LONG) -> DataFrame:
    """``df`` with a number from 1 by key in the given order."""

    def carry(told: DataFrame, w: WindowSpec) -> DataFrame:
        return told.withColumn("_before", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1))).drop("_n")

    return running(
        df, keys, order,
        lambda rows, by: rows.groupBy(*by).agg(F.count("*").alias("_n")),
        carry,
        lambda rows, w: rows.withColumn(name, F.row_number().over(w) + F.coalesce("_before", F.lit(0))),
        long,
    )
