"""Line streams: each line is redacted by itself, so a stream equals a batch line for line.

The plan has no state and no shuffle. Secrets that span lines are missed by design. The
ids that fired are gathered for each batch by `foreachBatch`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.catalog import Rule
from veilspark.operators.detect import redact_surface
from veilspark.operators.redact import redact
from veilspark.sources.text import split_failed


def lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of the lines (column value) of text files that arrive in a folder."""
    return spark.readStream.format("text").options(**options).load(path)


def redact_lines(stream: DataFrame, rules: Sequence[Rule], column: str = "value", deep: bool = True, errors: str | None = None) -> DataFrame:
    """redacted and rules for each line of command output (untrusted: markers don't count); errors names a column for what went wrong with a line, which then comes back whole."""
    return redact(stream, column, rules, False, errors=errors) if deep else redact_surface(stream, column, rules, False)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, gather: Callable[[list[str], int], None] | None = None, once: bool = True, dead: Callable[[DataFrame, int], None] | None = None, errors: str = "error") -> StreamingQuery:
    """Starts a query that gives each redacted batch to `write` and its distinct rule ids (no more than the catalog has) to `gather`. With `dead`, lines that failed go there and the others, less the errors' column, to `write`."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if dead is None:
                write(batch, number)
            else:
                fine, failed = split_failed(batch, errors)
                write(fine, number)
                dead(failed, number)
            if gather is not None:
                gather(sorted(r["rule"] for r in batch.select(F.explode("rules").alias("rule")).distinct().collect()), number)
        finally:
            batch.unpersist()

    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (q.trigger(availableNow=True) if once else q).start()


def audit_writer(spark: SparkSession, folder: str, log: str, order: str) -> Callable[[DataFrame, int], None]:
    """A writer for `run` that chains each batch of audit entries (see audit.chain) after what the logs end in.

    It's the logs' only writer. Batch n writes lines/batch=n and heads/batch=n (log, prev, line_no of every log so far), and
    reads the last heads before it; a batch that's repeated after a failure puts the same files again.
    """
    from veilspark.operators import audit

    def heads_before(number: int) -> DataFrame | None:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/heads")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        last = max((n for n in done if n < number), default=None)
        return None if last is None else spark.read.parquet(f"{folder}/heads/batch={last}")

    def write(batch: DataFrame, number: int) -> None:
        heads = heads_before(number)
        lines = audit.chain(batch, log, order, None if heads is None else heads.select("log", "prev"))
        if heads is not None:
            lines = lines.join(heads.select("log", F.col("line_no").alias("_at")), "log", "left").select("log", (F.col("line_no") + F.coalesce("_at", F.lit(0))).alias("line_no"), "line")
        lines.write.mode("overwrite").parquet(f"{folder}/lines/batch={number}")
        new = spark.read.parquet(f"{folder}/lines/batch={number}")
        ends = audit.last_hash(new).join(new.groupBy("log").agg(F.max("line_no").alias("line_no")), "log")
        if heads is not None:
            ends = ends.unionByName(heads.join(ends, "log", "left_anti"))
        ends.write.mode("overwrite").parquet(f"{folder}/heads/batch={number}")

    return write
