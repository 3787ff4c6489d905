"""Folders that driver and executors share, for intermediate tables, streams' checkpoints and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_homes: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. It is set here only where it is unset and the master is local, as in
    tests; elsewhere an unset folder is an error, because a machine-local one would be lost with its
    executor."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-lectern-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """The name of a new folder below the application's own in the shared one. The application's folder
    is deleted, with all that is in it, when the application ends."""
    home = f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}"
    if home not in _homes:
        path = spark._jvm.org.apache.hadoop.fs.Path(home)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _homes.add(home)
    return f"{home}/{label}-{uuid.uuid4().hex}"


def local_folder(spark: SparkSession, folder: str) -> str | None:
    """Makes the folder; its path where it lies in Hadoop's local file system, so that Python in any task can
    open what is below it, and None for any other store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    return path.toUri().getPath() if files.getScheme() == "file" else None


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: it cuts the lineage, and a
    lost executor costs a reread instead of the work above it."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
