"""Redaction of text columns: authored or untrusted, surface alone or with all passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.catalog import Rule
from veilspark.engine import DECODE_DEPTH, Engine, whole
from veilspark.functions.text import strip_ansi
from veilspark.operators.decode import MAY_BE_ENCODED
from veilspark.operators.deep import NATIVE_DEPTH, obfuscated, redacted
from veilspark.operators.detect import any_gate, redact_surface

_IDS = pa.list_(pa.string())
_RESULT = pa.struct([("text", pa.string()), ("rules", _IDS), ("error", pa.string())])
_TREE = pa.struct([("text", pa.string()), ("rules", _IDS), ("path", pa.string()), ("first", _IDS), ("fields", _IDS), ("error", pa.string())])


def worth_scanning(rules: Sequence[Rule], text: Column) -> Column:
    """Whether a text can hold anything to find: a rule's keyword, or a shape that may hide one. Evaluated in the JVM, so that other texts never reach Python."""
    # a shape comes first: where there's one, it's mostly met early, while keywords are looked for one after the other to the end
    return text.rlike(MAY_BE_ENCODED) | any_gate(rules, F.lower(strip_ansi(text))) | obfuscated(text)


def worth_walking(rules: Sequence[Rule], text: Column) -> Column:
    """The same of a JSON text, in which an escape may part a keyword."""
    return worth_scanning(rules, text) | text.contains("\\")


def guarded(run: Callable[[str], dict], raw: bytes) -> dict:
    """What run makes of a text; bytes that aren't UTF-8 are read as U+FFFD, and what's beside them counts. What it fails on is raised: without a result, a text would look clean."""
    try:
        return run(raw.decode("utf-8", "replace")) | {"error": None}
    except Exception as e:
        raise RuntimeError(f"a text of {len(raw)} bytes can't be scanned: {whole(f'{type(e).__name__}: {e}')[:200]}") from e


def _structs(rows: list[dict | None], kind: pa.StructType) -> pa.Array:
    """An Arrow array of structs, made field by field: from whole rows it takes several times as long."""
    fields = [pa.array([None if r is None else r.get(f.name) for r in rows], f.type) for f in kind]
    return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array([r is None for r in rows], pa.bool_()))


def _udf(rules: Sequence[Rule], authored: bool, depth: int, told: bool):
    """told: what a text fails on is its error, and others aren't concerned."""
    rules = tuple(rules)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        engine = Engine(rules, depth=depth)
        one = lambda t: dict(zip(("text", "rules"), engine.redact(t, authored)))

        def tried(raw: bytes) -> dict:
            try:
                return one(raw.decode()) | {"error": None}
            except Exception as e:  # noqa: BLE001  whatever it is, it's told
                return {"error": whole(f"{type(e).__name__}: {e}")[:200]}

        for texts in batches:
            yield _structs([None if t is None else tried(t) if told else guarded(one, t) for t in texts.cast(pa.binary()).to_pylist()], _RESULT)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<text: string, rules: array<string>, error: string>")


#: What redact() tells of a text that isn't UTF-8, where its decodings are nested too deep to be searched by their bytes.
NOT_UTF8 = "UnicodeError: not UTF-8, and it decodes to a third level"


@lru_cache(maxsize=64)
def _compiled(rules: tuple[Rule, ...], authored: bool, depth: int, leave: bool, _context: SparkContext) -> Column:
    """The expression over _v_text, made once for a set of rules: it has some thousand nodes."""
    text = F.col("_v_text")
    return F.when(worth_scanning(rules, text), redacted(text, rules, authored, depth, leave))


def redact(df: DataFrame, column: str, rules: Sequence[Rule], authored: bool = False, out: str = "redacted", hits: str = "rules", depth: int = DECODE_DEPTH, errors: str | None = None, native: bool = False) -> DataFrame:
    """df with the text redacted by all passes and the rule ids. Null and empty texts stay as they are.

    Texts in which a third level decodes pass the engine, and all rows wait for it with all their columns, on disk if need
    be. native: all levels are column expressions, so that long texts don't wait. `errors` names a column for
    errors: texts that aren't UTF-8 and decode to a third level then come back whole, with no ids and an error. Without
    it they're redacted, natively by their bytes.
    """
    text = F.col(column)
    once = _compiled(tuple(rules), authored, depth if native else min(depth, NATIVE_DEPTH), not native and depth > NATIVE_DEPTH, SparkContext._active_spark_context)
    # a generator, since expressions above a projection would each have its own copy of it worked out
    done = df.withColumn("_v_text", text).select("*", F.explode(F.array(once)).alias("_v_done"))
    best, ids = F.col("_v_done.text"), F.col("_v_done.rules")
    if not native and depth > NATIVE_DEPTH:
        # a second step: a struct read in the same one would run the UDF for each field
        done = done.withColumn("_v_deep", _udf(rules, authored, depth, errors is not None)(F.when(F.col("_v_done.more"), F.col("_v_text")))).withColumn("_v_error", F.col("_v_deep.error"))
        failed = F.col("_v_error").isNotNull()
        best, ids = F.when(~failed, F.coalesce(F.col("_v_deep.text"), best)), F.when(~failed, F.coalesce(F.col("_v_deep.rules"), ids))
    elif errors:
        error = F.when(F.col("_v_done.more") & ~F.is_valid_utf8(F.col("_v_text")), F.lit(NOT_UTF8)) if depth > NATIVE_DEPTH else F.lit(None).cast("string")
        done = done.withColumn("_v_error", error)
        best, ids = F.when(F.col("_v_error").isNull(), best), F.when(F.col("_v_error").isNull(), ids)
    made = done.withColumn(out, F.coalesce(best, F.col("_v_text"))).withColumn(hits, F.coalesce(ids, F.array().cast("array<string>")))
    return (made.withColumn(errors, F.col("_v_error")) if errors else made).drop("_v_text", "_v_done", "_v_deep", "_v_error")


#: Bytes of a text from which on it may have so many findings that to replace them one by one takes the square of the text.
LONG_BYTES = 1 << 16


def redact_files(df: DataFrame, column: str, rules: Sequence[Rule], authored: bool = False, out: str = "redacted", hits: str = "rules") -> DataFrame:
    """redact_surface of whole files, which may be long and full of findings: long ones pass the engine, whose time is linear in the text; others are redacted natively."""
    held = tuple(rules)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        engine = Engine(held)
        for texts in batches:
            yield pa.array([None if t is None else dict(zip(("text", "rules"), engine.redact_surface(t.decode("utf-8", "replace"), authored))) for t in texts.cast(pa.large_binary()).to_pylist()], pa.struct([("text", pa.string()), ("rules", _IDS)]))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    text = F.col(column)
    long = F.octet_length(text) > LONG_BYTES
    done = df.withColumn("_v_long", F.arrow_udf(run, "struct<text: string, rules: array<string>>").asNondeterministic()(F.when(long, text)))
    done = redact_surface(done.withColumn("_v_short", F.when(F.col("_v_long").isNull(), text)), "_v_short", rules, authored, "_v_out", "_v_hits")
    return done.withColumn(out, F.coalesce("_v_long.text", "_v_out")).withColumn(hits, F.coalesce("_v_long.rules", "_v_hits")).drop("_v_long", "_v_short", "_v_out", "_v_hits")


def tree_udf(rules: Sequence[Rule]):
    """(JSON text, mode) to struct(text, rules, path, first, fields, error); see Engine.redact_json. One for all modes: a plan with several would read its input once for each."""
    rules = tuple(rules)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        engine = Engine(rules)
        for texts, modes in batches:
            yield _structs([None if t is None else guarded(lambda s, m=m: engine.redact_json(s, m or ""), t) for t, m in zip(texts.cast(pa.binary()).to_pylist(), modes.to_pylist())], _TREE)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    # said to be nondeterministic so that a filter on its result isn't pushed below it, which would run it twice
    return F.arrow_udf(run, "struct<text: string, rules: array<string>, path: string, first: array<string>, fields: array<string>, error: string>").asNondeterministic()


__all__ = ["guarded", "redact", "redact_files", "redact_surface", "tree_udf", "worth_scanning", "worth_walking"]
