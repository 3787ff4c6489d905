"""A checkpoint log that is appended to, compacted now and then, and read as one.

Appends are JSON lines below ``tail``. Compaction writes what is there, with the snapshot before, as a new
snapshot of few Parquet files that lists the tail files it holds, and only then deletes those. A reader takes
the newest whole snapshot and the tail files that it does not list, so a compaction that was cut short, at
any point, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINTS = "job_id bigint, ord bigint, timestamp string, type string, message string"
#: Rows of a snapshot's file.
FILE_ROWS = 5_000_000


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def append_checkpoints(df: DataFrame, path: str) -> None:
    """Adds lines to a log whose lines are never rewritten."""
    df.select("job_id", "ord", "timestamp", "type", "message").write.mode("append").json(f"{path}/tail")


def _newest(spark: SparkSession, path: str) -> int:
    """The number of the newest whole snapshot, 0 if there is none."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    whole = [int(n.removeprefix("listed-")) for n in names if n.startswith("listed-") and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1])]
    return max(whole, default=0)


def _parts(spark: SparkSession, path: str, schema: str) -> tuple[int, DataFrame | None, DataFrame | None]:
    """The newest snapshot's number, its rows, and those of the tail that it does not hold, with ``_file``."""
    n = _newest(spark, path)
    rows = spark.read.schema(schema).parquet(f"{path}/rows-{n}") if n else None
    fs, tail = _fs(spark, f"{path}/tail")
    late = None
    if fs.exists(tail):
        late = spark.read.schema(schema).json(f"{path}/tail").withColumn("_file", F.col("_metadata.file_name"))
        if n:
            late = late.join(spark.read.schema("_file string").parquet(f"{path}/listed-{n}"), "_file", "left_anti")
    return n, rows, late


def read_checkpoints(spark: SparkSession, path: str, schema: str = CHECKPOINTS) -> DataFrame:
    """All lines of the log, each once."""
    _, rows, late = _parts(spark, path, schema)
    if late is None:
        return rows if rows is not None else spark.createDataFrame([], schema)
    late = late.drop("_file")
    return rows.unionByName(late) if rows is not None else late


def compact_checkpoints(spark: SparkSession, path: str, schema: str = CHECKPOINTS, file_rows: int = FILE_ROWS) -> int:
    """Writes the log as a new snapshot, sorted by job and ordinal, and returns its number. Tail files that
    come meanwhile stay in the tail. One compaction of a log runs at a time; readers of the snapshot before
    must have ended when the one after the next begins, as that deletes it."""
    n, rows, late = _parts(spark, path, schema)
    if late is None:
        return n
    # the files as they are now: what is appended from here on is not part of this snapshot
    names = late.select("_file").distinct()
    names.write.mode("overwrite").parquet(f"{path}/taking-{n + 1}")
    taken = spark.read.schema("_file string").parquet(f"{path}/taking-{n + 1}")
    new = late.join(taken, "_file", "left_semi").drop("_file")
    every = rows.unionByName(new) if rows is not None else new
    parts = max(1, -(-every.count() // file_rows))
    every.repartitionByRange(parts, "job_id", "ord").sortWithinPartitions("job_id", "ord").write.mode("overwrite").parquet(f"{path}/rows-{n + 1}")
    listed = taken
    fs, tail = _fs(spark, f"{path}/tail")
    if n:
        # files of earlier snapshots that could not be deleted yet
        there = [(s.getPath().getName(),) for s in fs.listStatus(tail)]
        before = spark.read.schema("_file string").parquet(f"{path}/listed-{n}")
        listed = listed.unionByName(before.join(spark.createDataFrame(there, "_file string"), "_file", "left_semi"))
    listed.write.mode("overwrite").parquet(f"{path}/listed-{n + 1}")
    for r in spark.read.schema("_file string").parquet(f"{path}/listed-{n + 1}").toLocalIterator():
        fs.delete(_fs(spark, f"{path}/tail/{r._file}")[1], False)
    fs.delete(_fs(spark, f"{path}/taking-{n + 1}")[1], True)
    for old in ("rows", "listed"):
        if n > 1:
            fs.delete(_fs(spark, f"{path}/{old}-{n - 1}")[1], True)
    return n + 1
