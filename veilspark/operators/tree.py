"""Walks and rewrites of nested values.

JSON of any shape is walked as a VARIANT inside its row, a level at a time, by a fold: strings are judged as they read once
decoded, rows stay where they are, and nothing is joined or gathered. (A recursive query would shuffle all values once for each
level and has a limit of rows.) Rewriting is done in Arrow batches, for rows in which something may hide. `redact_typed`
rewrites declared structs, arrays and maps by expressions made from the schema.
Keys are never scanned. Levels deeper than 64 are neither scanned nor rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.catalog import Rule
from veilspark.engine import DECODE_DEPTH, TREE_DEPTH
from veilspark.functions.text import parse_json
from veilspark.operators.decode import let
from veilspark.operators.deep import redacted
from veilspark.operators.redact import tree_udf, worth_scanning, worth_walking

_NODES = "array<struct<path string, at array<int>, node variant>>"
_LEAVES = "array<struct<path string, at array<int>, value string>>"


def scanned(df: DataFrame, column: str, rules: Sequence[Rule], mode: str, name: str, where: Column | None = None) -> DataFrame:
    """df with a struct (text, rules, path, first, fields, error) of a JSON text column, null where there's nothing to scan. A map: rows stay apart, whatever their keys."""
    text = F.col(column).cast("string")
    return df.withColumn(name, tree_udf(rules)(F.when(worth_walking(rules, text) if where is None else where, text), F.lit(mode)))


def leaves_of(tree: Column, levels: Column | None = None) -> Column:
    """array<struct<path, at, value>>: the strings of a VARIANT up to the depth. `at` has the place at each level, keys in their order, so leaves sort by it. levels: how many there are at most, if it's known."""
    none = F.array().cast(_NODES)

    def children(n: Column) -> Column:
        under = lambda path, i, node: F.struct(path.alias("path"), F.concat(n["at"], F.array(i)).alias("at"), node.alias("node"))
        named = lambda e, i: under(F.when(n["path"] == "", e["key"]).otherwise(F.concat(n["path"], F.lit("."), e["key"])), i, e["value"])
        placed = lambda v, i: under(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), i, v)
        # null for anything else; to ask for a node's schema would walk all that's below it
        fields = F.transform(F.map_entries(F.try_variant_get(n["node"], "$", "map<string,variant>")), named)
        items = F.transform(F.try_variant_get(n["node"], "$", "array<variant>"), placed)
        return F.coalesce(fields, items, none)

    def step(acc: Column, level: Column) -> Column:
        nested = lambda n: F.try_variant_get(n["node"], "$", "map<string,variant>").isNotNull() | F.try_variant_get(n["node"], "$", "array<variant>").isNotNull()
        strings = F.filter(acc["now"], lambda n: F.when(nested(n), F.lit(False)).otherwise(F.schema_of_variant(n["node"]) == "STRING"))
        new = F.transform(strings, lambda n: F.struct(n["path"].alias("path"), n["at"].alias("at"), F.try_variant_get(n["node"], "$", "string").alias("value")))
        below = F.when(level < TREE_DEPTH, F.flatten(F.transform(acc["now"], children))).otherwise(none)
        return F.when(F.size(acc["now"]) == 0, acc).otherwise(F.struct(below.alias("now"), F.concat(acc["out"], new).alias("out")))

    root = F.array(F.struct(F.lit("").alias("path"), F.array().cast("array<int>").alias("at"), tree.alias("node"))).cast(_NODES)
    zero = F.struct(root.alias("now"), F.array().cast(_LEAVES).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(TREE_DEPTH) if levels is None else F.least(F.lit(TREE_DEPTH), levels)), zero, step, lambda acc: acc["out"])


def json_leaves(text: Column) -> Column:
    """leaves_of a JSON text; one that isn't JSON, or in which a key is there twice, is one string, escaped slashes in it undone."""
    alone = F.array(F.struct(F.lit("").alias("path"), F.array().cast("array<int>").alias("at"), F.replace(text, F.lit("\\/"), F.lit("/")).alias("value"))).cast(_LEAVES)
    # each level is within one more bracket
    levels = F.length(text) - F.length(F.translate(text, "[{", ""))
    return let(parse_json(text), lambda tree: F.when(tree.isNotNull(), leaves_of(tree, levels)).otherwise(alone))


def leaves(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value: a row for each string in a JSON text column, in any order."""
    found = df.select(key, F.explode(json_leaves(F.col(column).cast("string"))).alias("_v_leaf"))
    return found.select(key, F.col("_v_leaf.path").alias("path"), F.col("_v_leaf.value").alias("value"))


@lru_cache(maxsize=64)
def _compiled(rules: tuple[Rule, ...], authored: bool, depth: int, _context: SparkContext) -> Column:
    """array<struct<at, path, rules>> of the leaves of _v_text with findings."""
    text = F.col("_v_text")

    def judged(leaf: Column) -> Column:
        return let(redacted(leaf["value"], rules, authored, depth), lambda r: F.struct(leaf["at"].alias("at"), leaf["path"].alias("path"), r["rules"].alias("rules")))

    def worth(leaf: Column) -> Column:
        return worth_scanning(rules, leaf["value"])

    hits = F.filter(F.transform(F.filter(json_leaves(text), worth), judged), lambda h: F.size(h["rules"]) > 0)
    return F.when(worth_walking(rules, text), hits)


def hits(df: DataFrame, key: str, column: str, rules: Sequence[Rule], authored: bool = False, depth: int = DECODE_DEPTH) -> DataFrame:
    """key, rules, fields (both distinct and sorted), field and first (of the first path, in order of keys, its rules) of rows with findings, in one walk. Leaves are judged by all passes, and none passes Python."""
    once = _compiled(tuple(rules), authored, depth, SparkContext._active_spark_context)
    made = df.select(key, F.col(column).cast("string").alias("_v_text")).select(key, F.explode(F.array(once)).alias("_v_hits")).where(F.size("_v_hits") > 0)
    named = lambda path: F.when(path == "", "(root)").otherwise(path)
    first = F.array_min(F.transform("_v_hits", lambda h: F.struct(h["at"].alias("at"), h["path"].alias("path"), h["rules"].alias("rules"))))
    ids = F.flatten(F.transform("_v_hits", lambda h: h["rules"]))
    paths = F.transform("_v_hits", lambda h: named(h["path"]))
    return made.select(key, F.array_sort(F.array_distinct(ids)).alias("rules"), F.array_sort(F.array_distinct(paths)).alias("fields"), first["path"].alias("field"), first["rules"].alias("first"))


def all_hits(df: DataFrame, key: str, column: str, rules: Sequence[Rule], authored: bool = False, depth: int = DECODE_DEPTH) -> DataFrame:
    """key, rules, fields of hits()."""
    return hits(df, key, column, rules, authored, depth).select(key, "rules", "fields")


def first_hit(df: DataFrame, key: str, column: str, rules: Sequence[Rule], authored: bool = False, depth: int = DECODE_DEPTH) -> DataFrame:
    """key, field, rules: of the first path, in order of keys, with a finding."""
    return hits(df, key, column, rules, authored, depth).select(key, "field", F.col("first").alias("rules"))


def rewrite(kind: T.DataType, value: Column, leaf: Callable[[Column], Column], depth: int = 0) -> Column:
    """A typed value with all its strings rewritten; other scalars and map keys stay."""
    if depth > TREE_DEPTH:
        return value
    if isinstance(kind, T.StringType):
        return leaf(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rewrite(kind.elementType, x, leaf, depth + 1))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: rewrite(kind.valueType, x, leaf, depth + 1))
    if isinstance(kind, T.StructType):
        made = F.struct(*[rewrite(f.dataType, value[f.name], leaf, depth + 1).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), made)
    return value


def redact_typed(df: DataFrame, column: str, rules: Sequence[Rule], out: str = "redacted", authored: bool = False) -> DataFrame:
    """df with a struct, array or map column's strings redacted, natively: surface matches, two levels of decoding, views."""

    kind = df.schema[column].dataType
    return df.withColumn(out, _typed(kind.json(), column, tuple(rules), authored, SparkContext._active_spark_context))


@lru_cache(maxsize=64)
def _typed(kind: str, column: str, rules: tuple[Rule, ...], authored: bool, _context: SparkContext) -> Column:
    def leaf(s: Column) -> Column:
        return F.when(worth_scanning(rules, s), redacted(s, rules, authored)["text"]).otherwise(s)

    return rewrite(T._parse_datatype_json_string(kind), F.col(column), leaf)


def redact_json(df: DataFrame, column: str, rules: Sequence[Rule], authored: bool = False, unwrap: bool = False, out: str = "redacted") -> DataFrame:
    """df with a JSON text column redacted (unchanged where clean) and columns rules, path (of the first hit) and fields. unwrap: text that is JSON in a JSON string counts as the inner one."""
    text = F.col(column)
    done = scanned(df, column, rules, "a" * authored + "u" * unwrap, "_v_tree")
    none = F.array().cast("array<string>")
    return (
        done.withColumn(out, F.coalesce(F.col("_v_tree.text"), text))
        .withColumn("rules", F.coalesce(F.col("_v_tree.rules"), none))
        .withColumn("path", F.coalesce(F.col("_v_tree.path"), F.lit("")))
        .withColumn("fields", F.coalesce(F.col("_v_tree.fields"), none))
        .drop("_v_tree")
    )
