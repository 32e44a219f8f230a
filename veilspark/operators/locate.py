"""Findings with their places: lines from 0, columns in bytes from 1, the last one that of the last byte."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.catalog import Rule
from veilspark.functions.text import line_starts, strip_ansi
from veilspark.operators.decode import let
from veilspark.operators.deep import NATIVE_DEPTH, searched
from veilspark.operators.detect import any_gate, findings, near_marker

PLACES = ("line", "start_line", "start_col", "end_line", "end_col")


def place_of(text: Column, at: Column, part: Column) -> Column:
    """struct(line, start_line, start_col, end_line, end_col) of a part without line ends that begins at a character of a text, from 1."""

    def placed(before: Column) -> Column:
        row = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
        head = F.substring_index(before, "\n", -1)
        col = F.octet_length(head)
        rest = F.substring_index(F.substring(text, at + F.length(part), F.length(text)), "\n", 1)
        return F.struct(F.concat(head, part, rest).alias("line"), row.alias("start_line"), (col + 1).alias("start_col"), row.alias("end_line"), (col + F.octet_length(part)).alias("end_col"))

    return let(F.substring(text, F.lit(1), at - 1), placed)


def find(df: DataFrame, column: str, rules: Sequence[Rule], authored: bool = False, decoded: bool = False) -> DataFrame:
    """A row for each finding in a text less its terminal escapes, in order of rules and places: df's columns, rule_id, match, secret, encoded, line, start_line, start_col, end_line, end_col.

    decoded: also what segments decode to, two levels deep; its place is that of the segment (encoded) where it first stands.
    authored: without findings near a marker.
    """
    text = F.col("_v_bare")
    df = df.withColumn("_v_bare", strip_ansi(F.col(column)))
    found = findings(rules, text, F.lower(text), located=True)
    if authored:
        found = F.filter(found, lambda f: ~near_marker(f["line"], f["match"]))
    names = ("rule_id", "match", "secret", "encoded", *PLACES)
    rows = F.transform(found, lambda f: F.struct(*[(F.lit("") if n == "encoded" else f[n]).alias(n) for n in names]))
    if not decoded:
        rows = F.when(any_gate(rules, F.lower(text)), rows)
    else:

        def put(f: Column) -> Column:
            return let(place_of(text, F.instr(text, f["encoded"]), f["encoded"]), lambda p: F.struct(*[(p if n in PLACES else f)[n].alias(n) for n in names]))

        deep = F.filter(searched(rules, text, authored, NATIVE_DEPTH)["found"], lambda f: f["encoded"] != "")
        rows = F.concat(rows, F.transform(deep, put))
    return df.withColumn("_v_f", F.explode(rows)).select("*", *[F.col(f"_v_f.{n}").alias(n) for n in names]).drop("_v_bare", "_v_f")


def segment_at(text: Column, start_line: Column, end_line: Column, start_col: Column, end_col: Column) -> Column:
    """The bytes from one column to another of a line, as text; null where that's on several lines, or not in the text."""
    raw = F.encode(text, "UTF-8")

    def cut(base: Column) -> Column:
        first, last = base + start_col, base + end_col
        fits = (start_line == end_line) & (first >= 1) & (last <= F.octet_length(text)) & (first <= last)
        return F.when(fits, F.substring(raw, first, last - first + 1).cast("string"))

    return let(F.get(line_starts(text), F.when(start_line >= 0, start_line)), cut)
