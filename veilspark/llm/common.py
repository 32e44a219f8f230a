"""Shared helpers: reading tables, folders that all executors share, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Tables of texts up to this size are dealt out to all cores, as they may lie in one row group, which is one task's work.
SMALL_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages") and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The folder is spark.checkpoint.dir. Where that is unset, a local master gets
    a temporary folder and a cluster gets an error, since its machines share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'veilspark-shared')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/veilspark-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage is cut and executors may go."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["settled_at"] = path
    return out


def unsettle(df: DataFrame) -> None:
    """Deletes a settled table, once nothing reads it any more."""
    if path := df.__dict__.get("settled_at"):
        drop_dir(df.sparkSession, path)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's values as UTF-8."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def as_list(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def ascii_lower(text):
    """A-Z become a-z; all else stays. lower() does just that to ASCII, and is far faster than translate()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, key: str, least: int = 0) -> DataFrame:
    """df dealt out by key, for tasks that need all rows of a key.

    The number of partitions is never the session's: a join on the key would have that, Spark
    would then drop this exchange as redundant, and adaptive execution may after all
    read the join by other partitions, as no operator states that it needs them so.
    """
    return df.repartition(max(shuffle_partitions(df.sparkSession) + 1, least), key)
