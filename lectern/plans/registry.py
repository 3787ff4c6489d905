"""Queries by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name. In ``sql``, ``{NAME}`` stands for a derived input."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            for name in ("NOISY", "PARAGRAPHS", "CHECKPOINTS", "ATTEMPTS", "ORDER_SECTIONS", "CONFIG", "SIGNALS"):
                sql_now = getattr(fixtures, name)
                ORACLES[f.__name__] = ORACLES.get(f.__name__, sql).replace("{" + name + "}", f"({sql_now})")
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
