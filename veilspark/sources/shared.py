"""Folders that the driver and all executors can reach."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; under the machine's temporary folder if that's unset and Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has machines of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "veilspark-shared")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Bytes of a table, as it's stored, that one task has at most.
TASK_BYTES = 4 << 20
#: What Spark doesn't know the size of, it takes to be larger than this.
UNKNOWN_BYTES = 1 << 50


def stored(df: DataFrame) -> int:
    """Bytes of a table as Spark estimates them before it's read: those of its files, in proportion to its columns."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt_in(spark: SparkSession, size: int) -> int:
    """The number of tasks for costly work on a table of so many stored bytes: it grows with these, so that no task does."""
    tasks = size // TASK_BYTES + 1 if size < UNKNOWN_BYTES else 0
    return max(2 * spark.sparkContext.defaultParallelism, tasks)


def spread(df: DataFrame) -> DataFrame:
    """A table dealt out to all cores before costly work on its rows, in ever more tasks as it grows: of any size, it may lie in few row groups, each of which is one task's work."""
    return df.repartition(dealt_in(df.sparkSession, stored(df)))


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def arrived(spark: SparkSession, path: str, to: str) -> None:
    """A folder, if it's there, at its place in a folder that a stream reads, all at once."""
    at, put = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.mkdirs(put.getParent())
        if not fs.rename(at, put):
            raise OSError(f"{path} can't be moved to {to}")
