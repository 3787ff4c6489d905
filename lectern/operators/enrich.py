"""Calling a user's function for every chunk, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

OUTCOME = "success boolean, attempts int, error string, payload double"


def calls(
    make: Callable[[], Callable[..., float | None]], text: Column,
    retry_attempts: int = 3, retry_delay: float = 0.0, accept: Callable[[str, float], bool] | None = None, parallel: int = 1, numbered: bool = False,
) -> Column:
    """The outcomes of a function on a text column, which alone goes to Python."""

    def call(function: Callable[..., float | None], value: str) -> tuple[bool, int, str | None, float | None]:
        error = None
        for attempt in range(1, retry_attempts + 1):
            try:
                payload = function(value, attempt) if numbered else function(value)
                if payload is not None and (accept is None or attempt == retry_attempts or accept(value, payload)):
                    return True, attempt, None, payload
                error = "no result" if payload is None else "refused"
            except Exception as problem:  # noqa: BLE001  a user's function may raise anything
                error = f"{type(problem).__name__}: {problem}"
            if retry_delay and attempt < retry_attempts:
                time.sleep(retry_delay)
        return False, retry_attempts, error, None

    @F.pandas_udf(OUTCOME)
    def outcomes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        function = make()
        with ThreadPoolExecutor(parallel) as pool:
            for texts in batches:
                told = list(pool.map(lambda t: call(function, t), texts)) if parallel > 1 else [call(function, t) for t in texts]
                yield pd.DataFrame({n: pd.Series([x[i] for x in told], dtype=object) for i, n in enumerate(("success", "attempts", "error", "payload"))})

    return outcomes.asNondeterministic()(text)


def enrich_chunks(df: DataFrame, make: Callable[[], Callable[..., float | None]], text: str = "text", **policy) -> DataFrame:
    """``df`` with ``success``, ``attempts``, ``error`` and ``payload`` of a function that may fail.

    ``make`` is called once for each task and gives the function (a client is set up there, not for
    each chunk). An exception or None is a failure and tried again up to ``retry_attempts`` times, after
    ``retry_delay`` seconds; with ``accept`` a payload it refuses is tried again as well, but taken on the
    last attempt. So many calls of a task run at a time as ``parallel`` says; the function must bear that.
    With ``numbered`` the function is given the number of the attempt too, from 1: it cannot tell that from
    the texts, as equal texts that follow one another may be one object.
    Whether failures stop a job is for ``halt_at_first_failure`` to say.
    """
    return df.withColumn("_outcome", calls(make, F.col(text), **policy)).select(*df.columns, "_outcome.*")


def enrich_once(
    df: DataFrame, make: Callable[[], Callable[[str], float | None]], log: str, key: str, text: str = "text",
    chunks_per_task: int = 200, again: bool = False, **policy,
) -> DataFrame:
    """As ``enrich_chunks``, but no call that has ended is made again by a later run, whatever became of the
    run that made it: outcomes are kept in a log, in a folder that all executors share, and only chunks
    without one are called for.

    ``key`` names each chunk. Chunks are called for in tasks of about ``chunks_per_task``; a task's outcomes
    are in the log as soon as it ends, so a run that dies loses the calls of its unfinished tasks at most,
    and a lost executor none of its finished ones. Chunks that failed for good have an outcome too; with
    ``again`` they are called for once more, and the newer outcome holds. The log is read back and joined
    to ``df``; nothing but key and text is dealt to the tasks that call.
    """
    spark = df.sparkSession
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {OUTCOME}, run bigint"
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    logged = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(log) if there else spark.createDataFrame([], schema)
    run = (logged.agg(F.max("run")).first()[0] or 0) + 1
    ended = logged.filter("success") if again else logged
    todo = df.select(key, text).join(ended.select(key), key, "left_anti")
    left = todo.count()
    if left:
        dealt = todo.repartition(-(-left // chunks_per_task), key)
        made = dealt.withColumn("_outcome", calls(make, F.col(text), **policy)).select(key, "_outcome.*", F.lit(run).cast("bigint").alias("run"))
        # the second form of committing puts a task's file in its place when the task ends
        made.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(log)
        logged = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(log)
    newest = logged.groupBy(key).agg(F.max_by(F.struct("success", "attempts", "error", "payload"), "run").alias("_outcome"))
    return df.join(newest, key, "left").select(*df.columns, "_outcome.*")


def in_range_flags(speed: Column, model: Column, voice: Column, models: list[str], voices: list[str]) -> Column:
    """What is wrong with a request: speed outside 0.25 to 4, unknown model, unknown voice."""
    return F.struct((~speed.between(0.25, 4.0)).alias("bad_speed"), (~model.isin(*models)).alias("bad_model"), (~voice.isin(*voices)).alias("bad_voice"))


def est_cost(chars: Column, usd_per_million: Column) -> Column:
    return chars / F.lit(1e6) * usd_per_million
