"""The whole redaction of a text as one column expression: surface matches, what levels of decoding show, and views of obfuscated lines.

A text and whatever its segments decode to are searched by one set of rules, in which each rule occurs once, so
plans stay small. Two levels are unrolled; deeper ones are folded, for texts that have any. `redacted` says which have.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.catalog import Rule
from veilspark.functions.text import ENTITY, INVISIBLE_CLASS, normalized_views, placeholder, strip_ansi
from veilspark.operators.decode import SEGMENT, decodings, deeper, let
from veilspark.operators.detect import MARKERS, SHORT_BYTES, findings, leaks, near_marker, splice

#: A finding, and the segment that stands in the text in place of a decoded match.
FOUND = "array<struct<rule_id string, match string, secret string, encoded string>>"
#: Levels of decoding that expressions are unrolled for; below, they're folded.
NATIVE_DEPTH = 2
_IDS = "array<string>"


def obfuscated(s: Column) -> Column:
    """Whether a text may have a view that differs from it. What's rare is looked for first: other than ASCII, separators beside hex pairs, ampersands."""
    pair = "[0-9A-Fa-f]{2}[-: ]"
    return ((F.octet_length(s) != F.length(s)) & s.rlike(INVISIBLE_CLASS)) | s.rlike(f"[-: ]{pair}{pair}") | (s.contains("&") & s.rlike(ENTITY))


def surely_redacted(rules: Sequence[Rule], text: Column) -> Column:
    """Whether redacting a text, authored or not, takes a secret out of it, as far as that's plain to see; where it isn't, whether or not it does, false.

    That's so if a match and its secret can't come back by way of a placeholder, nor be near a marker, and the text has no
    character of a placeholder's or terminal's own: whatever else is found, the text changes and this one is gone.
    """
    plain = (F.octet_length(text) == F.length(text)) & ~text.rlike("[<>\x1b]") & ~reduce(lambda a, b: a | b, [text.contains(m) for m in MARKERS])
    names = [r.id.lower().replace(" ", "-") for r in rules]

    def lasting(s: Column) -> Column:
        """A placeholder holds a string without a colon in its first word, the rule's name or the last four characters of a secret."""
        return reduce(lambda a, b: a & b, [~F.lit(n).contains(s) for n in names], (F.length(s) > SHORT_BYTES) & ~s.contains(":"))

    return plain & F.exists(findings(rules, text, F.lower(text)), lambda f: lasting(f["match"]) & lasting(f["secret"]))


def _near_everywhere(text: Column, segment: Column) -> Column:
    """Whether all lines that hold a segment have a marker near it."""
    return ~F.exists(F.split(text, "\n", -1), lambda line: line.contains(segment) & ~near_marker(line, segment))


def searched(rules: Sequence[Rule], text: Column, authored: bool, depth: int = NATIVE_DEPTH, leave: bool = False) -> Column:
    """struct(found, more): findings of a text and of what its segments decode to, distinct, in order; and whether anything decodes to a level below the depth, or below two if it's larger. leave: if so, it isn't searched."""
    none = F.array().cast(SEGMENT)
    once = decodings(text) if depth > 0 else none

    def body(d1: Column) -> Column:
        return let(F.when(F.size(d1) > 0, deeper(d1)).otherwise(none) if depth > 1 else none, lambda d2: over(d1, d2))

    def step(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        return F.when(F.size(last) > 0, F.concat(levels, F.array(deeper(last)))).otherwise(levels)

    def over(d1: Column, d2: Column) -> Column:
        last = d2 if depth > 1 else d1
        return judged(F.concat(d1, d2), F.exists(last, lambda d: F.size(decodings(d["text"])) > 0) if depth > 0 else text.rlike("(?!)"))

    def judged(decoded: Column, more: Column) -> Column:
        units = F.concat(F.array(F.struct(F.lit("").alias("segment"), text.alias("text"))), decoded)
        lowered = F.transform(units, lambda u: F.struct(u["segment"].alias("segment"), u["text"].alias("text"), F.lower(u["text"]).alias("low")))

        def of(u: Column) -> Column:
            found = findings(rules, u["text"], u["low"], located=authored)
            if authored:
                found = F.filter(found, lambda f: ~F.when(u["segment"] == "", near_marker(f["line"], f["match"])).otherwise(_near_everywhere(text, u["segment"])))
            return F.transform(found, lambda f: F.struct(f["rule_id"].alias("rule_id"), f["match"].alias("match"), f["secret"].alias("secret"), u["segment"].alias("encoded")))

        found = F.array_distinct(F.flatten(F.transform(lowered, of)))
        if not leave:
            return F.struct(found.alias("found"), more.alias("more"))
        return let(more, lambda m: F.struct(F.when(m, F.array().cast(FOUND)).otherwise(found).alias("found"), m.alias("more")))

    if depth > NATIVE_DEPTH:
        levels = F.aggregate(F.sequence(F.lit(2), F.lit(depth)), F.array(once), step)
        return let(levels, lambda x: judged(F.flatten(x), F.coalesce(F.size(F.get(x, F.lit(NATIVE_DEPTH))) > 0, F.lit(False))))
    return let(once, body)


def _form(f: Column) -> tuple[Column, Column]:
    """What a finding is in the text, and what else of it must go."""
    return F.when(f["encoded"] != "", f["encoded"]).otherwise(f["match"]), F.when(f["encoded"] != "", f["encoded"]).otherwise(f["secret"])


def _seen_through(rules: Sequence[Rule], text: Column, authored: bool, depth: int, leave: bool) -> Column:
    """array<struct(line, ids, more)>: the lines of a text, those with findings in a view as a placeholder of the first one."""

    def line(s: Column) -> Column:
        def judged(hits: Column) -> Column:
            found = F.flatten(F.transform(hits, lambda h: h["found"]))
            ph = let(F.get(found, F.lit(0)), lambda f: placeholder(f["rule_id"], f["secret"], f["match"]))
            more = F.exists(hits, lambda h: h["more"])
            ids = F.array_distinct(F.transform(found, lambda f: f["rule_id"]))
            return F.struct(F.when(F.size(found) > 0, ph).otherwise(s).alias("line"), ids.alias("ids"), more.alias("more"))

        plain = F.struct(s.alias("line"), F.array().cast(_IDS).alias("ids"), F.lit(False).alias("more"))
        seen = let(F.transform(let(strip_ansi(s), normalized_views), lambda v: searched(rules, v, authored, depth, leave)), judged)
        return F.when(obfuscated(s), seen).otherwise(plain)

    return F.transform(F.split(text, "\n", -1), line)


def redacted(text: Column, rules: Sequence[Rule], authored: bool = False, depth: int = NATIVE_DEPTH, leave: bool = False) -> Column:
    """struct(text, rules, more): the redacted text, ids of rules whose secrets are gone (none if nothing changed), and whether it decodes further than searched() says. leave: if so, another pass does the whole text, and it's left as it is."""
    none = F.array().cast(_IDS)

    def spliced(s: Column) -> Column:
        return let(F.when(F.size(s["found"]) > 0, splice(text, s["found"], _form)).otherwise(text), lambda out: attested(s, out))

    def attested(s: Column, out: Column) -> Column:
        def gone(f: Column) -> Column:
            needle, secret = _form(f)
            return let(F.struct(needle.alias("needle"), secret.alias("secret")), lambda x: ~leaks(out, strip_ansi(out), x["needle"], x["secret"]))

        ids = F.transform(F.filter(s["found"], gone), lambda f: f["rule_id"])
        return F.when(obfuscated(out), let(_seen_through(rules, out, authored, depth, leave), lambda lines: ended(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.concat(ids, F.flatten(F.transform(lines, lambda x: x["ids"]))), s["more"] | F.exists(lines, lambda x: x["more"])))).otherwise(ended(out, ids, s["more"]))

    def ended(out: Column, ids: Column, more: Column) -> Column:
        return F.struct(out.alias("text"), F.when(out != text, F.array_distinct(ids)).otherwise(none).alias("rules"), more.alias("more"))

    def told(s: Column) -> Column:
        return F.when(s["more"], F.struct(text.alias("text"), none.alias("rules"), s["more"].alias("more"))).otherwise(spliced(s)) if leave else spliced(s)

    return let(let(strip_ansi(text), lambda bare: searched(rules, bare, authored, depth, leave)), told)
