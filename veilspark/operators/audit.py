"""Hash-chained event logs: canonical JSON, chaining and verification.

An entry is the JSON object {ts, tool, action, rules?, count?, field?, prev, hash} in that
order; its hash is the SHA-256 of the entry with an empty hash, and prev is the hash of
the entry before. Verification needs just the line before, so logs are cut into ranges of
lines that carry the last hash over to the next one, however long a log is; chaining
is sequential by nature and done in order within each log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.functions.text import parse_json, short_hash
from veilspark.sources.shared import dealt_in, stored

FIELDS = {"ts": "string", "tool": "string", "action": "string", "rules": "array<string>", "count": "bigint", "field": "string", "prev": "string", "hash": "string"}
#: Line numbers of a log that are verified together.
RANGE = 50_000


def entry_of(line: Column) -> dict[str, Column]:
    """An entry's fields, and whether it is one (ok): a JSON object whose known fields are null, missing or of their types. Else its fields are null."""
    tree = parse_json(line)
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    at = lambda name: F.try_variant_get(tree, f"$.{name}", "variant")
    ok = tree.isNotNull() & kind(tree).startswith("OBJECT")
    for name, type_ in FIELDS.items():
        allowed = {"string": ("STRING", "VOID"), "bigint": ("BIGINT", "VOID"), "array<string>": ("ARRAY<STRING>", "ARRAY<VOID>", "VOID")}[type_]
        ok &= kind(at(name)).isin(*allowed)
    ok = F.coalesce(ok, F.lit(False))
    return {name: F.when(ok, F.try_variant_get(tree, f"$.{name}", type_)) for name, type_ in FIELDS.items()} | {"ok": ok}


def json_string(s: Column) -> Column:
    """A JSON string literal with <, >, & and line separators escaped, and control characters in lower-case hex."""
    # one element array: to_json quotes the string, the brackets go
    quoted = F.to_json(F.array(F.coalesce(s, F.lit(""))))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    for c, e in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        quoted = F.replace(quoted, F.lit(c), F.lit(e))
    for n in (0x0A, 0x0B, 0x0C, 0x0E, 0x0F, *range(0x1A, 0x20)):
        quoted = F.replace(quoted, F.lit(f"\\u{n:04X}"), F.lit(f"\\u{n:04x}"))
    return quoted


def canonical(e: dict[str, Column], hash_: Column | None = None) -> Column:
    """An entry as JSON; without hash_ the form that is hashed."""
    rules, count, field = e["rules"], e["count"], e["field"]
    return F.concat(
        F.lit('{"ts":'), json_string(e["ts"]), F.lit(',"tool":'), json_string(e["tool"]), F.lit(',"action":'), json_string(e["action"]),
        F.when(F.coalesce(F.size(rules), F.lit(0)) > 0, F.concat(F.lit(',"rules":['), F.array_join(F.transform(rules, json_string), ","), F.lit("]"))).otherwise(F.lit("")),
        F.when(F.coalesce(count, F.lit(0)) != 0, F.concat(F.lit(',"count":'), count.cast("string"))).otherwise(F.lit("")),
        F.when(F.coalesce(field, F.lit("")) != "", F.concat(F.lit(',"field":'), json_string(field))).otherwise(F.lit("")),
        F.lit(',"prev":'), json_string(e["prev"]), F.lit(',"hash":'), json_string(F.lit("") if hash_ is None else hash_), F.lit("}"),
    )


def entry_hash(e: dict[str, Column]) -> Column:
    return F.sha2(canonical(e), 256)


_MARK = "prev"


def chain(events: DataFrame, log: str, order: str, ends: DataFrame | None = None) -> DataFrame:
    """Entries of each log, chained in order: log, line_no, line. events: ts, tool, action, rules, count, field and the two columns named; ends: log, prev that chains begin from, else "".

    The canonical text is made natively with a mark for prev; only the hashing, which
    needs the entry before, runs entry by entry, streaming, in each log's own order.
    """
    parts = {c: F.col(c) for c in ("ts", "tool", "action", "rules", "count", "field")} | {"prev": F.lit(_MARK)}
    made = events.select(F.col(log).alias("log"), F.col(order).alias("_order"), canonical(parts).alias("text"))
    made = made.withColumn("prev", F.lit("")) if ends is None else made.join(ends, "log", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, prev, line = object(), "", 0
        for batch in batches:
            out = []
            for name, _, text, end in zip(*(c.to_pylist() for c in batch.columns)):
                if name != now:
                    now, prev, line = name, end or "", 0
                line += 1
                text = text.replace(_MARK, prev, 1)
                prev = hashlib.sha256(text.encode()).hexdigest()
                out.append((name, line, text[:-2] + prev + '"}'))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["log", "line_no", "line"])

    kind = made.schema["log"].dataType.simpleString()
    # not the session's number: a join on log would make this exchange redundant, and adaptive execution could then split a log
    parts = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt_in(events.sparkSession, stored(events))) + 1
    return made.repartition(parts, "log").sortWithinPartitions("log", "_order").mapInArrow(run, f"log {kind}, line_no long, line string")


def verify(lines: DataFrame, range_: int = RANGE) -> DataFrame:
    """log, line_no, kind (ok, legacy, parse, hash, chain), detail for each line that isn't empty. lines: log, line_no, line.

    A line of a log is compared with the one before in its range of line numbers, a range's first with what the
    range before ends in; only the ranges' ends, of which there are few, are put in order for a whole log.
    """
    held = lines.where(F.col("line") != "").select("log", "line_no", "line", F.floor(F.col("line_no") / range_).alias("_range"))
    ends = held.groupBy("log", "_range").agg(F.max_by("line", "line_no").alias("line"))
    ends = ends.select(F.col("log").alias("_log"), F.col("_range").alias("_of"), F.coalesce(entry_of(F.col("line"))["hash"], F.lit("")).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy("_log").orderBy("_of"))).drop("_end")
    e = entry_of(F.col("line"))
    full = held.select("log", "line_no", "_range", F.struct(*[c.alias(n) for n, c in e.items()]).alias("e"))
    e = {c: F.col(f"e.{c}") for c in FIELDS}
    full = full.select("log", "line_no", "_range", F.col("e.ok").alias("is_entry"), F.coalesce(e["hash"], F.lit("")).alias("stored"), entry_hash(e).alias("computed"), F.coalesce(e["prev"], F.lit("")).alias("prev"))
    full = full.join(ends, full["log"].eqNullSafe(ends["_log"]) & (full["_range"] == ends["_of"]), "left")
    before = F.lag("stored").over(Window.partitionBy("log", "_range").orderBy("line_no"))
    full = full.withColumn("expected", F.coalesce(before, F.col("_carry"), F.lit("")))
    kind = F.when(~F.col("is_entry"), "parse").when(F.col("stored") == "", "legacy").when(F.col("stored") != F.col("computed"), "hash").when(F.col("prev") != F.col("expected"), "chain").otherwise("ok")
    detail = (
        F.when(F.col("kind") == "parse", F.lit("invalid JSON"))
        .when(F.col("kind") == "hash", F.concat(F.lit("entry tampered: stored "), short_hash(F.col("stored")), F.lit(" ≠ recomputed "), short_hash(F.col("computed"))))
        .when(F.col("kind") == "chain", F.concat(F.lit("chain break: prev="), short_hash(F.col("prev")), F.lit(", expected "), short_hash(F.col("expected"))))
        .otherwise(F.lit(""))
    )
    return full.withColumn("kind", kind).select("log", "line_no", "kind", detail.alias("detail"))


def summary(verified: DataFrame) -> DataFrame:
    """log, total, verified, legacy, broken, ok. Legacy entries don't fail a log."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return verified.groupBy("log").agg(F.count("*").alias("total"), n("ok").alias("verified"), n("legacy").alias("legacy"), n("parse", "hash", "chain").alias("broken")).withColumn("ok", F.col("broken") == 0)


def last_hash(lines: DataFrame) -> DataFrame:
    """log, prev: the hash that the next entry of each log must carry; only the last lines are read as entries."""
    last = lines.where("line <> ''").groupBy("log").agg(F.max_by("line", "line_no").alias("line"))
    return last.select("log", F.coalesce(entry_of(F.col("line"))["hash"], F.lit("")).alias("prev"))


def append(lines: DataFrame, events: DataFrame, log: str, order: str) -> DataFrame:
    """Lines of the logs with the events chained after what they end in. A single writer for each log is needed, as with foreachBatch."""
    new = chain(events, log, order, last_hash(lines))
    at = lines.groupBy("log").agg(F.max("line_no").alias("_at"))
    moved = new.join(at, "log", "left").select("log", (F.col("line_no") + F.coalesce("_at", F.lit(0))).alias("line_no"), "line")
    return lines.select("log", "line_no", "line").unionByName(moved)
