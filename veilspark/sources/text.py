"""Sources and sinks: whole texts, lines, event JSON, dotenv candidates, logs."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.sources.shared import dealt_in, stored

MAX_LINE_BYTES, MAX_PARENTS = 4 << 20, 32


def whole(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text: each file as one text."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def events(spark: SparkSession, path: str, harness: str, event: str) -> DataFrame:
    """harness, event, tool, payload from JSON lines; lines that aren't JSON objects have no tool."""
    raw = spark.read.text(path).withColumnRenamed("value", "payload")
    tool = F.coalesce(F.get_json_object("payload", "$.tool_name"), F.get_json_object("payload", "$.toolName"), F.get_json_object("payload", "$.tool"), F.lit(""))
    return raw.select(F.lit(harness).alias("harness"), F.lit(event).alias("event"), tool.alias("tool"), "payload")


def local_path(path: Column) -> Column:
    """A path without the scheme and host of a local file's address, its percent signs decoded."""
    return F.when(path.rlike("^file:"), F.replace(F.try_url_decode(F.replace(F.regexp_replace(path, "^file:(?://[^/]*)?/*", "/"), F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/"))).otherwise(path)


#: Where events name the file that is read, and the transcript.
FILE, TRANSCRIPT = "$.tool_input.file_path", "$.transcript_path"
#: Stored bytes of files that may be broadcast; in memory they may be many times that.
FEW_BYTES = 1 << 20


def with_files(events: DataFrame, files: DataFrame) -> DataFrame:
    """events with file_text: the text of the file or transcript that each names. files: path, text; one row for each path.

    Files are joined by a merge unless they're few. Rows are dealt out again after the join, whose tasks needn't grow in
    number with the input, nor get as many rows each: many events may name one file.
    """
    named = files.select(local_path(F.col("path")).alias("_path"), F.col("text").alias("file_text"))
    wanted = F.coalesce(F.get_json_object("payload", FILE), F.get_json_object("payload", TRANSCRIPT))
    size = stored(files)
    # a column: a sort by an expression would work it out for each comparison
    joined = events.withColumn("_wanted", local_path(wanted)).join(named if size <= FEW_BYTES else named.hint("merge"), F.col("_wanted") == F.col("_path"), "left").drop("_path", "_wanted")
    return joined.repartition(dealt_in(events.sparkSession, stored(events) + size))


def log_lines(spark: SparkSession, path: str, log: Callable[[Column], Column] = lambda file: file) -> DataFrame:
    """log, line_no, line of audit logs; blank lines count in the numbers. A longer line than 4 MiB is cut off as unreadable.

    log: of a file's path, its log's name; a log of several files has them in the order of their paths. Files are read in
    Spark's own splits, and no line is shuffled or sorted. A line's number is its place in its split, which its task
    knows, and the lines of the splits before; a row for each split is all that's broadcast.
    """
    # ids ascend by one within a split, and are the same in both reads: filters aren't pushed below them
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), "value", F.monotonically_increasing_id().alias("_id"))
    held = raw.groupBy("_file", "_at").agg(F.count("*").alias("n"), F.min("_id").alias("_first")).withColumn("log", log(F.col("_file")))
    before = Window.partitionBy("log").orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("log", "_file", "_at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_ahead"))
    line = F.regexp_replace("value", r"\r\z", "")
    out = raw.join(F.broadcast(offsets), ["_file", "_at"])
    return out.select("log", (F.col("_id") + F.col("_ahead")).alias("line_no"), F.when(F.octet_length(line) <= MAX_LINE_BYTES, line).otherwise(F.lit("unreadable")).alias("line"))


def split_failed(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, less its column, and rows with one; of the result of redact(..., errors=error)."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def write_dead_letters(failed: DataFrame, path: str, column: str, error: str = "error", mode: str = "append") -> None:
    """Puts rows that couldn't be redacted aside as Parquet: their columns, the text as bytes, whatever these are."""
    failed.withColumn(column, F.col(column).cast("binary")).write.mode(mode).parquet(path)


def write_lines(df: DataFrame, path: str, column: str = "redacted") -> None:
    df.select(F.col(column).alias("value")).write.mode("error").text(path)


def digests(pieces: DataFrame, key: str, order: Sequence[str], column: str) -> DataFrame:
    """key (a long), n, digest: lines and MD5 of the pieces (binary) of each key, one after the other in their order. Pieces stream by in Arrow batches, which Spark bounds by bytes; no key's text is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda k, n, made: pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([made.hexdigest()], pa.string())], names=[key, "n", "digest"])
        now = None
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1)):
                k, raw = k.as_py(), memoryview(text.as_buffer())
                if now is None or now[0] != k:
                    if now is not None:
                        yield row(*now)
                    now = [k, 0, hashlib.md5(usedforsecurity=False)]
                now[1] += bytes(raw).count(b"\n")
                now[2].update(raw)
        if now is not None:
            yield row(*now)

    return pieces.repartition(F.col(key)).sortWithinPartitions(key, *order).select(key, column).mapInArrow(run, f"{key} long, n long, digest string")


def write_copies(decided: DataFrame) -> DataFrame:
    """Writes the redacted copies of files that policy.decide() redirects to, and returns copy and n_bytes for each.

    A copy's path follows from its file's path and text, so a repeated task writes the same file again; it's written
    under another name first, so that it's never met half written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{quote(path)}")
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                own = f"{at}.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as f:
                    f.write(text.encode())
                fs.move(own, at)
                sizes.append(len(text.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["copy", "n_bytes"])

    return decided.where("copy is not null").select("copy", "copy_text").distinct().mapInArrow(run, "copy string, n_bytes long")


def dotenv_files(start: str) -> list[str]:
    """.env of start and of the git root above it, each once."""
    here = os.path.realpath(start)
    found, root = [here], here
    for _ in range(MAX_PARENTS):
        if os.path.exists(os.path.join(root, ".git")):
            found.append(root)
            break
        if os.path.dirname(root) == root:
            break
        root = os.path.dirname(root)
    return [p for p in dict.fromkeys(os.path.join(d, ".env") for d in found) if os.path.isfile(p)]
