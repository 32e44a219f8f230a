"""Findings and redaction of surface matches as native column expressions.

Findings come in catalog order, then by place. A rule is evaluated only where one of its
keywords occurs (CASE short-circuits), and rules are literals in the plan, not a table to
join, so patterns are compiled once and nothing is multiplied.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.catalog import Rule, Term, terms_of, to_java, to_python
from veilspark.functions.text import entropy, placeholder, strip_ansi
from veilspark.operators.decode import let

#: Notes that mark a value as intended, honoured in authored text alone.
MARKERS = ("veilspark:fixture", "veilspark:allow", "gitleaks:allow", "betterleaks:allow")
MARKER_BYTES, SHORT_BYTES = 120, 12
#: What made-up secrets look like.
ALPHABET, ONE_LETTER = "abcdefghijklmnopqrstuvwxyz", r"\A([A-Za-z])(?i:\1)*\z"
#: What depends on the text around a match: look-around and the text's ends.
_CONTEXT = re.compile(r"\(\?<?[=!]|\\[Az]")
FINDING = "struct<rule_id string, match string, secret string>"
LOCATED = "struct<rule_id string, match string, secret string, line string, start_line int, start_col int, end_line int, end_col int>"


def gate(rule: Rule, lowered: Column) -> Column:
    """Whether a rule is to run on a text, given in lower case."""
    return reduce(lambda a, b: a | b, [lowered.contains(k) for k in rule.keywords]) if rule.keywords else F.lit(True)


def any_gate(rules: Sequence[Rule], lowered: Column) -> Column:
    return reduce(lambda a, b: a | b, [gate(r, lowered) for r in rules])


def discarded(term: Term, secret: Column) -> Column:
    if term.kind == "entropy":
        return F.round(entropy(secret), 9) <= term.limit  # sums may differ in their last bits
    if term.kind == "any":
        return reduce(lambda a, b: a | b, [secret.rlike(to_java(v)) for v in term.values])
    return reduce(lambda a, b: a | b, [secret.contains(v) for v in term.values])


def dummy(secret: Column) -> Column:
    """Whether a secret holds the whole alphabet or is one letter repeated: such values are made up, whatever the rule."""
    return secret.contains(ALPHABET) | secret.rlike(ONE_LETTER)


def occurrences(rule: Rule, text: Column) -> Column:
    """array<LOCATED>: all matches of a rule with their secrets, lines and places.

    A text is split at the matches, which gives what lies between them; places add up from there. Lines are counted from 0,
    columns in bytes from 1, and the last column is that of the match's last byte.
    """
    regex = F.lit(to_java(rule.regex))
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    secrets = F.regexp_extract_all(text, regex, F.lit(1)) if _groups(rule) else matches
    between = F.split(text, to_java(rule.regex), -1)
    zero = F.struct(F.lit(0).alias("line"), F.lit(0).alias("col"), F.split(text, "\n", -1).alias("lines"), F.array().cast(f"array<{LOCATED}>").alias("out"))

    def moved(at: Column, s: Column) -> Column:
        n = F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
        col = F.octet_length(F.substring_index(s, "\n", -1))
        return F.struct((at["line"] + n).alias("line"), F.when(n > 0, col).otherwise(at["col"] + col).alias("col"))

    def step(acc: Column, x: Column) -> Column:
        def add(ends: Column) -> Column:
            a, b = ends["a"], ends["b"]
            line = F.array_join(F.slice(acc["lines"], a["line"] + 1, b["line"] - a["line"] + 1), "\n")
            secret = F.when(x["secret"] == "", x["match"]).otherwise(x["secret"])
            one = F.struct(F.lit(rule.id).alias("rule_id"), x["match"].alias("match"), secret.alias("secret"), line.alias("line"), a["line"].alias("start_line"), (a["col"] + 1).alias("start_col"), b["line"].alias("end_line"), b["col"].alias("end_col"))
            return F.struct(b["line"].alias("line"), b["col"].alias("col"), acc["lines"].alias("lines"), F.concat(acc["out"], F.array(one)).alias("out"))

        return let(let(moved(acc, x["between"]), lambda a: F.struct(a.alias("a"), moved(a, x["match"]).alias("b"))), add)

    zipped = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("between"), matches.alias("match"), secrets.alias("secret"))
    return F.when(F.size(matches) > 0, F.aggregate(zipped, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{LOCATED}>"))


def _groups(rule: Rule) -> int:
    return re.compile(to_python(rule.regex), re.ASCII).groups


def rule_findings(rule: Rule, text: Column, lowered: Column, located: bool = False, made_up: bool = False) -> Column:
    """array<FINDING> of one rule, or array<LOCATED>; each occurrence is judged by the lines that it lies on. made_up: with secrets that look so (see dummy())."""
    regex = to_java(rule.regex)
    made = lambda m, s: F.struct(F.lit(rule.id).alias("rule_id"), m.alias("match"), F.when(s == "", m).otherwise(s).alias("secret"))
    if located or rule.allow:
        pairs = occurrences(rule, text)
    else:
        matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
        if not _groups(rule):
            pairs = F.transform(matches, lambda m: made(m, m))
        elif _CONTEXT.search(regex):
            pairs = F.zip_with(matches, F.regexp_extract_all(text, F.lit(regex), F.lit(1)), made)
        else:  # a match by itself matches as it did in the text, so the text is gone through once
            pairs = F.transform(matches, lambda m: made(m, F.regexp_extract(m, rf"\A(?:{regex})\z", 1)))
    if not made_up:
        pairs = F.filter(pairs, lambda f: ~dummy(f["secret"]))
    terms = terms_of(rule)
    if terms:
        pairs = F.filter(pairs, lambda f: ~reduce(lambda a, b: a | b, [discarded(t, f["secret"]) for t in terms]))
    if rule.allow:
        pairs = F.filter(pairs, lambda f: ~reduce(lambda a, b: a | b, [f["line"].rlike(to_java(x)) for x in rule.allow]))
        if not located:
            pairs = unplaced(pairs)
    return F.when(gate(rule, lowered), pairs).otherwise(F.array().cast(f"array<{LOCATED if located else FINDING}>"))


def unplaced(found: Column) -> Column:
    """Findings without their places."""
    return F.transform(found, lambda f: F.struct(f["rule_id"].alias("rule_id"), f["match"].alias("match"), f["secret"].alias("secret")))


def findings(rules: Sequence[Rule], text: Column, lowered: Column, located: bool = False) -> Column:
    return F.concat(*[rule_findings(r, text, lowered, located) for r in rules]) if rules else F.array().cast(f"array<{LOCATED if located else FINDING}>")


def near_marker(lines: Column, match: Column, markers: Sequence[str] = MARKERS) -> Column:
    """Whether a marker is within MARKER_BYTES of the first occurrence of a match on the lines that it lies on, and on the line that it begins on."""
    at = F.instr(lines, match)
    before = F.encode(F.substring_index(F.substring(lines, F.lit(1), at - 1), "\n", -1), "UTF-8")
    after = F.encode(F.when(match.contains("\n"), F.lit("")).otherwise(F.substring_index(F.substring(lines, at + F.length(match), F.length(lines)), "\n", 1)), "UTF-8")
    n = F.octet_length(before)
    left = F.substring(before, F.greatest(n - MARKER_BYTES + 1, F.lit(1)), F.lit(MARKER_BYTES))
    around = F.concat(left, F.encode(F.substring_index(match, "\n", 1), "UTF-8"), F.substring(after, F.lit(1), F.lit(MARKER_BYTES)))
    return reduce(lambda a, b: a | b, [F.contains(around, F.lit(m.encode())) for m in markers])


def survives(text: Column, form: Column) -> Column:
    """Whether a form is still in a text; short ones count only as words of their own."""
    word = F.concat(F.lit(r"(?<![A-Za-z0-9_-])\Q"), F.replace(form, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z0-9_-])"))
    return F.when(~F.contains(text, form), False).when(F.octet_length(form) <= SHORT_BYTES, F.regexp_like(text, word)).otherwise(True)


def leaks(text: Column, bare: Column, match: Column, secret: Column) -> Column:
    """Whether match or secret is still in a text, or in it without its escapes (bare)."""
    return survives(text, match) | ((match != secret) & survives(text, secret)) | (text.contains("\x1b") & (survives(bare, match) | survives(bare, secret)))


def splice(text: Column, found: Column, form=lambda f: (f["match"], f["secret"])) -> Column:
    """text with every finding's match replaced, in turn; where a form survives, its lines are, and then the whole text. form: of a finding, what stands for it in the text, and what else must go."""

    # expressions in lambdas are worked out wherever they stand, so what's used twice is bound
    def step(acc: Column, f: Column) -> Column:
        needle, secret = form(f)
        by = F.struct(needle.alias("needle"), secret.alias("secret"), placeholder(f["rule_id"], f["secret"], f["match"]).alias("ph"))
        return let(by, lambda x: let(F.replace(acc, x["needle"], x["ph"]), lambda plain: F.when(left(plain, x), wider(plain, x)).otherwise(plain)))

    def left(s: Column, x: Column) -> Column:
        return leaks(s, strip_ansi(s), x["needle"], x["secret"])

    def wider(s: Column, x: Column) -> Column:
        lines = F.array_join(F.transform(F.split(s, "\n", -1), lambda line: F.when(left(line, x), x["ph"]).otherwise(line)), "\n")
        return let(lines, lambda out: F.when(left(out, x), x["ph"]).otherwise(out))

    return F.aggregate(found, text, step)


def redact_surface(df: DataFrame, column: str, rules: Sequence[Rule], authored: bool = False, out: str = "redacted", hits: str = "rules") -> DataFrame:
    """df with the redacted text and the ids of rules whose secrets are gone. Null text stays null, with no rules."""
    text, bare, low, found = "_v_text", "_v_bare", "_v_low", "_v_found"
    step = df.withColumn(text, F.col(column)).withColumn(bare, strip_ansi(F.col(text))).withColumn(low, F.lower(F.col(bare)))
    list_ = findings(rules, F.col(bare), F.col(low), located=authored)
    if authored:  # each occurrence by its own lines; where one stays a finding, all copies of it go
        list_ = unplaced(F.filter(list_, lambda f: ~near_marker(f["line"], f["match"])))
    # a finding counts once however often its match occurs
    step = step.withColumn(found, F.when(any_gate(rules, F.col(low)), F.array_distinct(list_)).otherwise(F.array().cast(f"array<{FINDING}>")))
    step = step.withColumn(out, F.when(F.size(found) > 0, splice(F.col(text), F.col(found))).otherwise(F.col(text)))
    gone = F.filter(F.col(found), lambda f: ~leaks(F.col(out), strip_ansi(F.col(out)), f["match"], f["secret"]))
    ids = F.when((F.size(found) > 0) & (F.col(out) != F.col(text)), F.array_distinct(F.transform(gone, lambda f: f["rule_id"]))).otherwise(F.array().cast("array<string>"))
    return step.withColumn(hits, F.coalesce(ids, F.array().cast("array<string>"))).drop(text, bare, low, found)


def suppressed(df: DataFrame, column: str, rules: Sequence[Rule], out: str = "suppressed") -> DataFrame:
    """df with the ids of rules whose findings a marker keeps from being redacted, for the audit log."""
    bare = strip_ansi(F.col(column))
    marked = F.filter(findings(rules, bare, F.lower(bare), located=True), lambda f: near_marker(f["line"], f["match"]))
    return df.withColumn(out, F.coalesce(F.array_distinct(F.transform(marked, lambda f: f["rule_id"])), F.array().cast("array<string>")))
