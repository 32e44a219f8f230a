r"""What encoded segments of a text decode to, natively: base64, hex, percent escapes and \u or U+ escapes.

A segment counts only if it decodes to printable ASCII. All patterns are runs of one class or of pieces of one
length: they take time linear in the text and no stack in java.util.regex, however long a run is. The engine, which
decodes deeper than column expressions are unrolled, reads the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE64 = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: A whole run; those of odd length are left out.
HEX = r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{16,}"
_URL = r"A-Za-z0-9_.~+/=:%-"
PERCENT = rf"(?<![{_URL}])[{_URL}]*%[0-9A-Fa-f]{{2}}[{_URL}]*"
#: What a text with such a run holds; looking for it takes less than looking behind each character.
HEXED = "[0-9A-Fa-f]{16}"
#: What each of these segments holds.
ESCAPE = "%[0-9A-Fa-f]{2}"
#: Of the second one, a space at the end isn't part of the segment.
UNICODE = (r"(?:\\u[0-9A-Fa-f]{4})++", r"(?:U\+[0-9A-Fa-f]{4} )++(?:U\+[0-9A-Fa-f]{4})?", r"(?:U\+[0-9A-Fa-f]{4})++")
CODE = r"(?:\\u|U\+)([0-9A-Fa-f]{4})"
#: Whether any of the above can find anything.
MAY_BE_ENCODED = r"[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|U\+[0-9A-Fa-f]{4}"
PRINTABLE = r"\A[\t\n\r -~]+\z"

SEGMENT = "array<struct<segment string, text string>>"


def let(value: Column, body) -> Column:
    """body(value), in which the value is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Characters of a long run that are decoded first; if they aren't printable, the rest isn't either. A multiple of 4.
_HEAD = 64


def _base64(s: Column) -> Column:
    def full(bare: Column) -> Column:
        # the pattern leaves nothing to validate but the length, and only ASCII
        n = F.octet_length(bare)
        padded = F.concat(bare, F.left(F.lit("=="), (4 - n % 4) % 4))
        made = lambda x: F.unbase64(x).cast("string")
        binary = F.when(n > 4 * _HEAD, ~made(F.left(bare, F.lit(_HEAD))).rlike(PRINTABLE)).otherwise(F.lit(False))
        return F.when((n % 4 != 1) & ~binary, made(padded))

    bare = F.when(s.endswith("="), F.rtrim(s, F.lit("="))).otherwise(s)
    return let(F.when(bare.contains("-") | bare.contains("_"), F.translate(bare, "-_", "+/")).otherwise(bare), full)


def _percent(s: Column) -> Column:
    kept = F.regexp_replace(F.replace(s, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.nullif(F.try_url_decode(kept), s)


def _unicode(s: Column) -> Column:
    codes = F.transform(F.regexp_extract_all(s, F.lit(CODE), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))
    plain = F.forall(codes, lambda c: c < 127)
    return F.when(plain, F.array_join(F.transform(codes, lambda c: F.char(c)), ""))


def decodings(text: Column) -> Column:
    """array<struct<segment, text>> of the segments that decode to printable ASCII: base64, hex, percent, then escapes, each in order."""

    none = F.array().cast(SEGMENT)

    def found(pattern: str, decode, held: Column | None = None) -> Column:
        each = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.struct(F.when(s.endswith(" "), F.rtrim(s)).otherwise(s).alias("segment"), decode(s).alias("text")))
        return each if held is None else F.when(held, each).otherwise(none)

    hexed = lambda s: F.when(F.length(s) % 2 == 0, F.unhex(s).cast("string"))
    every = F.concat(found(BASE64, _base64), found(HEX, hexed, text.rlike(HEXED)), found(PERCENT, _percent, text.contains("%") & text.rlike(ESCAPE)), *[found(p, _unicode, text.contains(h)) for p, h in zip(UNICODE, ("\\u", "U+", "U+"))])
    return F.when(text.rlike(MAY_BE_ENCODED), F.filter(every, lambda d: F.coalesce(d["text"].rlike(PRINTABLE), F.lit(False)))).otherwise(none)


def deeper(found: Column) -> Column:
    """What the decoded texts of decodings() decode to in turn, with the outermost segments."""
    return F.flatten(F.transform(found, lambda d: F.transform(decodings(d["text"]), lambda e: F.struct(d["segment"].alias("segment"), e["text"].alias("text")))))
