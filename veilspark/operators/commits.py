"""Audit logs that several writers append to at once, without a lock.

A writer chains its entries after what the logs end in as of the last commit, writes the lines and the logs' new heads under a
name of its own, and then claims the next commit number: a file that only one writer can create names what it wrote. A writer that
comes too late chains anew after the winner's heads and tries again. Readers see claimed commits alone, so what a writer that died
left behind is never read, and a commit is there with its lines and heads or not at all.
"""

from __future__ import annotations

import random
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import audit

HEAD = "log string, prev string, line_no bigint"


class Contended(RuntimeError):
    """A writer came too late as often as it was told to try."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commits(spark: SparkSession, folder: str) -> list[str]:
    """Names of what was written, in order of commits; numbers follow each other, so they are claimed in turn."""
    fs, at = _path(spark, f"{folder}/commits")
    if not fs.exists(at):
        return []
    numbered = sorted(((int(s.getPath().getName()), s.getPath()) for s in fs.listStatus(at) if re.fullmatch(r"\d+", s.getPath().getName())), key=lambda x: x[0])
    return [_read(fs, p) for _, p in numbered]


def _read(fs, at) -> str:
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _claim(spark: SparkSession, folder: str, number: int, name: str) -> bool:
    """Whether this writer gets the commit number. A file with the name is made first, then put in place unless something is there: whole or not at all."""
    fs, own = _path(spark, f"{folder}/claims/{name}")
    fs.mkdirs(own.getParent())
    out = fs.create(own, True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    fs, at = _path(spark, f"{folder}/commits/{number:012d}")
    fs.mkdirs(at.getParent())
    if fs.getUri().getScheme() != "file":
        return bool(fs.rename(own, at))  # the store refuses where something is there
    files, paths = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Paths
    local = lambda p: paths.get(fs.makeQualified(p).toUri())
    try:  # a rename would replace what's there; a link doesn't
        files.createLink(local(at), local(own))
    except Exception as e:  # noqa: BLE001
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def heads(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """log, prev, line_no that each log ends in."""
    return spark.read.schema(HEAD).parquet(f"{folder}/heads/{names[-1]}") if names else spark.createDataFrame([], HEAD)


def append(spark: SparkSession, folder: str, entries: DataFrame, log: str, order: str, tries: int = 50) -> int:
    """Appends entries (see audit.chain) to the logs in a folder that all writers share, as one commit; its number. Contended after so many tries."""
    entries = entries.withColumn(log, F.col(log).cast("string")).persist()
    try:
        for attempt in range(tries):
            names, name = commits(spark, folder), uuid.uuid4().hex
            now = heads(spark, folder, names)
            made = audit.chain(entries, log, order, now.select("log", "prev"))
            made = made.join(now.select("log", F.col("line_no").alias("_at")), "log", "left").select("log", (F.col("line_no") + F.coalesce("_at", F.lit(0))).alias("line_no"), "line")
            made.write.parquet(f"{folder}/lines/{name}")
            new = spark.read.parquet(f"{folder}/lines/{name}")
            ends = audit.last_hash(new).join(new.groupBy("log").agg(F.max("line_no").alias("line_no")), "log")
            ends.unionByName(now.join(ends, "log", "left_anti")).write.parquet(f"{folder}/heads/{name}")
            if _claim(spark, folder, len(names), name):
                return len(names)
            for part in ("lines", "heads", "claims"):
                fs, at = _path(spark, f"{folder}/{part}/{name}")
                fs.delete(at, True)
            time.sleep(random.random() * 0.2 * min(attempt + 1, 10))
    finally:
        entries.unpersist()
    raise Contended(f"{tries} commits by other writers came first")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """log, line_no, line of all commits."""
    names = commits(spark, folder)
    kind = "log string, line_no bigint, line string"
    return spark.read.schema(kind).parquet(*[f"{folder}/lines/{n}" for n in names]) if names else spark.createDataFrame([], kind)
