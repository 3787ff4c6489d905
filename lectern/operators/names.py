"""Names that are free: the first use of a name keeps it, later ones get the smallest number that makes a
name nobody has yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from ..sources.scratch import stored
from .ordered import LONG, numbered, running


def _parts(name: Column, stem_aware: bool) -> tuple[Column, Column]:
    """The part of a name that a number follows, and the rest (the suffix of a file)."""
    if not stem_aware:
        return name, F.lit("")
    suffix = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix)), suffix


def _running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, long: int) -> DataFrame:
    """The sum of ``value`` over the rows before, by key."""

    def carry(told: DataFrame, w: WindowSpec) -> DataFrame:
        return told.withColumn("_carried", F.sum("_told").over(w.rowsBetween(W.unboundedPreceding, -1))).drop("_told")

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        own = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1))
        return rows.withColumn(name, F.coalesce(own, F.lit(0)) + F.coalesce("_carried", F.lit(0)))

    return running(rows, keys, order, lambda r, by: r.groupBy(*by).agg(F.sum(value).alias("_told")), carry, add, long)


def suffix_collisions(df: DataFrame, name: str, order: str, scope: list[str] | None = None, stem_aware: bool = False, long: int = LONG) -> DataFrame:
    """``df`` with ``unique_name``: row by row in the given order, the name if no row of the ``scope``
    before has it, else the name with ``_2``, ``_3`` and so on, whichever is the first that is free; in
    file names (``stem_aware``) the number stands before the suffix. Names given are as taken as names
    asked for: ``a, a, a_2`` become ``a, a_2, a_2_2``. Orders must differ within a scope.

    A name ``x_j`` can only go to a row that asks for it or to one that asks for ``x``, and the numbers
    given to those who ask for ``x`` rise. So whether the k-th of them passes over ``x_j`` is settled by
    whether ``x_j`` was asked for before, and whether the first who asks for ``x_j`` finds it gone by
    whether the k-th came before. Only names that end in a number of another name that is asked for take
    part in this; their states are worked out in rounds, as one may rest on that of a smaller number or
    of a shorter name, until none changes. All else is a running number by name.
    """
    keys = scope or []
    stem, suffix = _parts(F.col(name), stem_aware)
    rows = df.withColumn("_name", F.coalesce(name, F.lit(""))).withColumn("_stem", stem).withColumn("_suffix", suffix)
    rows = numbered(rows, [*keys, "_name"], [order], "_n", long)
    asked = rows.groupBy(*keys, "_name").agg(F.min(order).alias("_first"), F.count("*").alias("_asked"))
    child_stem, child_suffix = _parts(F.col("_name"), stem_aware)
    number = F.regexp_extract(child_stem, r"_([2-9]|[1-9][0-9]{1,17})$", 1)
    child = asked.withColumn("_j", number.try_cast("bigint")).filter("_j is not null")
    child = child.withColumn("_parent", F.concat(F.substr(child_stem, F.lit(1), F.length(child_stem) - F.length(number) - 1), child_suffix))
    met = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    state = child.alias("c").join(asked.alias("p"), [*met, F.col("c._parent") == F.col("p._name")], "left_semi")
    state = stored(state.select(*keys, "_name", "_parent", "_j", "_first", F.lit(False).alias("_passed"), F.lit(False).alias("_lost")), "numbered_names")
    if state.isEmpty():
        return _named(rows.withColumn("_k", F.col("_n") - 1).withColumn("_over", F.lit(0)), name)

    on = lambda a, b, more: [*[F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], *more]
    parents = state.select(*keys, F.col("_parent").alias("_name")).distinct()
    turns = stored(rows.alias("r").join(parents.alias("p"), on("r", "p", [F.col("r._name") == F.col("p._name")]), "left_semi").select(*keys, "_name", "_n", F.col(order).alias("_turn")), "name_turns")
    changed = 1
    while changed:
        before = _running_sum(state.withColumn("_is", F.col("_passed").cast("bigint")), [*keys, "_parent"], ["_j"], "_is", "_below", long).drop("_is")
        lost = state.select(*keys, F.col("_name").alias("_of"), F.col("_lost").alias("_parent_lost"))
        told = before.alias("c").join(lost.alias("p"), on("c", "p", [F.col("c._parent") == F.col("p._of")]), "left")
        told = told.select("c.*", F.coalesce("_parent_lost", F.lit(False)).alias("_parent_lost"))
        # the turn that comes to this number: the k-th of those of the parent that need one
        told = told.withColumn("_k", F.col("_j") - 1 - F.col("_below")).withColumn("_at", F.col("_k") + F.when(F.col("_parent_lost"), 0).otherwise(1))
        told = told.alias("c").join(turns.alias("t"), on("c", "t", [F.col("c._parent") == F.col("t._name"), F.col("c._at") == F.col("t._n")]), "left").select("c.*", "t._turn")
        told = told.withColumn("_now_passed", F.coalesce(F.col("_first") <= F.col("_turn"), F.lit(False))).withColumn("_now_lost", F.coalesce(F.col("_turn") < F.col("_first"), F.lit(False)))
        told = stored(told, "numbered_names")
        changed = told.filter((F.col("_passed") != F.col("_now_passed")) | (F.col("_lost") != F.col("_now_lost"))).count()
        passed = told.filter("_now_passed").select(*keys, "_parent", "_k")
        state = told.select(*keys, "_name", "_parent", "_j", "_first", F.col("_now_passed").alias("_passed"), F.col("_now_lost").alias("_lost"))
    gone = state.filter("_lost").select(*keys, F.col("_name").alias("_of"), F.lit(0).alias("_own"))
    rows = rows.alias("r").join(gone.alias("g"), on("r", "g", [F.col("r._name") == F.col("g._of")]), "left").select("r.*", (F.col("r._n") - F.coalesce("g._own", F.lit(1))).alias("_k"))
    # numbers passed over up to each turn: the passes are laid among the turns and counted
    marks = passed.select(*keys, F.col("_parent").alias("_name"), "_k", F.lit(1).alias("_mark"))
    laid = rows.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    counted = _running_sum(laid, [*keys, "_name"], ["_k", F.desc("_mark")], "_mark", "_over", long).filter("_mark = 0")
    return _named(counted.drop("_mark"), name)


def _named(rows: DataFrame, name: str) -> DataFrame:
    given = F.concat("_stem", F.lit("_"), (F.col("_k") + 1 + F.col("_over")).cast("string"), "_suffix")
    return rows.withColumn("unique_name", F.when(F.col("_k") == 0, F.col(name)).otherwise(given)).drop("_name", "_stem", "_suffix", "_n", "_k", "_over")
