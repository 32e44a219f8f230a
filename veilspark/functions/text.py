"""Scalar string operators as column expressions."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: escape sequences of terminals (CSI, OSC, short).
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[@-Z\\-_]"
#: Fixed value: zero-width, soft hyphen, marks and bidi controls.
INVISIBLE = (0x00AD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF)
INVISIBLE_CLASS = "[" + "".join(f"\\x{{{c:04X}}}" for c in INVISIBLE) + "]"
#: Runs of hex pairs, and HTML entities.
HEX_RUN = r"(?i)[0-9a-f]{2}(?:[-: ][0-9a-f]{2}){3,}"
ENTITY = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]+);"
#: A secret of so many bytes has its last four characters in its placeholder.
TAIL_BYTES = 12


def strip_ansi(s: Column) -> Column:
    return F.when(s.contains("\x1b"), F.regexp_replace(s, ANSI, "")).otherwise(s)


#: Escapes of halves of surrogate pairs, which text can't hold; a VARIANT with such a key can't be read.
_HALVES = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def parse_json(s: Column) -> Column:
    """A JSON text as a VARIANT, halves of surrogate pairs as replacement characters; null if it isn't JSON."""
    return F.try_parse_json(F.when(s.contains("\\ud") | s.contains("\\uD"), F.regexp_replace(s, _HALVES, r"\\ufffd")).otherwise(s))


def strip_invisible(s: Column) -> Column:
    return F.when(F.octet_length(s) != F.length(s), F.regexp_replace(s, INVISIBLE_CLASS, "")).otherwise(s)


def collapse_hex(s: Column) -> Column:
    """Runs of at least four hex pairs joined by - : or space, without what joins them."""
    runs = F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(HEX_RUN), F.lit(0))), lambda a, b: F.length(b) - F.length(a))
    # what joins pairs is looked for first: few texts have it between so many of them
    return F.when(s.rlike(HEX_RUN), F.aggregate(runs, s, lambda acc, r: F.replace(acc, r, F.translate(r, "-: ", "")))).otherwise(s)


def code_point(n: Column) -> Column:
    """The character of a code point; the replacement character for those that text can't hold."""
    ok = (n > 0) & (n < 0x110000) & ~((n >= 0xD800) & (n < 0xE000))
    # UTF-8 by hand: to decode from another charset looks the charset up for each value
    return F.when(ok, _utf8(n)).otherwise(F.lit("\ufffd"))


def _utf8(n: Column) -> Column:
    """The bytes of a code point that text can hold, as text."""
    rest = lambda shift: F.shiftright(n, shift).bitwiseAND(F.lit(0x3F).cast("long")) + 0x80
    made = lambda *bytes_: F.unhex(F.concat(*map(F.hex, bytes_))).cast("string")
    return (
        F.when(n < 0x80, F.char(n))
        .when(n < 0x800, made(F.shiftright(n, 6) + 0xC0, rest(0)))
        .when(n < 0x10000, made(F.shiftright(n, 12) + 0xE0, rest(6), rest(0)))
        .otherwise(made(F.shiftright(n, 18) + 0xF0, rest(12), rest(6), rest(0)))
    )


#: Numbers 128 to 159 mean characters of Windows-1252.
CP1252 = {b: ord(bytes([b]).decode("cp1252", "replace")) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "replace") != "\ufffd"}


def _numeric(entity: Column) -> Column:
    """A numeric entity's character."""
    hexed = entity.startswith("&#x") | entity.startswith("&#X")
    digits = F.ltrim(F.substring(entity, F.when(hexed, 4).otherwise(3), F.length(entity)), F.lit("0"))
    odd = F.create_map(*[F.lit(x).cast("long") for pair in CP1252.items() for x in pair])

    def value(d: Column) -> Column:  # d ends in a semicolon
        n = F.substring(d, F.lit(1), F.length(d) - 1)
        return F.when(F.octet_length(d) > 9, F.lit(0x110000).cast("long")).when(hexed, F.conv(n, 16, 10).cast("long")).otherwise(n.try_cast("long"))

    of = lambda n: F.when((n >= 0x80) & (n < 0xA0), F.coalesce(F.try_element_at(odd, n), n)).otherwise(n)
    return _let(_let(digits, lambda d: F.coalesce(value(d), F.lit(0).cast("long"))), lambda n: _let(of(n), code_point))


def _let(value: Column, body) -> Column:
    """body(value), in which the value is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decode_entities(s: Column, named: bool = True) -> Column:
    """HTML entities with a closing semicolon decoded, longest first, in one pass for each distinct entity; & last, so that nothing is decoded twice."""
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(ENTITY), F.lit(0)))
    numeric = F.filter(found, lambda e: e.startswith("&#"))
    # what decodes to & is put in as a private mark until the end
    mark = "\ue000"
    out = F.aggregate(numeric, s, lambda acc, e: F.replace(acc, e, _let(_numeric(e), lambda c: F.when(c == "&", F.lit(mark)).otherwise(c))))
    if named:
        table = F.from_json(F.lit(_named()), "map<string,string>")  # folded to a literal
        names = F.filter(found, lambda e: ~e.startswith("&#"))
        out = F.aggregate(names, out, lambda acc, e: F.replace(acc, e, F.coalesce(F.try_element_at(table, e), e)))
    return F.when(s.contains("&") & s.rlike(ENTITY), F.replace(out, F.lit(mark), F.lit("&"))).otherwise(s)


@lru_cache(maxsize=1)
def _named() -> str:
    """HTML's names with a closing semicolon and their characters, as JSON."""
    return json.dumps({f"&{k}": "\ue000" if v == "&" else v for k, v in html5.items() if k.endswith(";")})


def normalized_views(line: Column) -> Column:
    """Distinct forms of a line that differ from it, each from one pass."""
    return F.array_distinct(F.filter(F.array(strip_invisible(line), collapse_hex(line), decode_entities(line)), lambda v: v != line))


def placeholder(rule: Column, secret: Column, match: Column) -> Column:
    """<REDACTED:rule[:last four]>."""
    name = F.replace(F.lower(F.coalesce(rule, F.lit(""))), F.lit(" "), F.lit("-"))
    name = F.when(name == "", F.lit("secret")).otherwise(name)
    value = F.when(F.coalesce(secret, F.lit("")) == "", F.coalesce(match, F.lit(""))).otherwise(secret)
    tail = F.when(F.octet_length(value) >= TAIL_BYTES, F.concat(F.lit(":"), F.right(value, F.lit(4)))).otherwise(F.lit(""))
    return F.concat(F.lit("<REDACTED:"), name, tail, F.lit(">"))


def line_starts(s: Column) -> Column:
    """Byte at which each line begins."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, line: F.struct((acc["at"] + F.octet_length(line) + 1).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(F.split(s, "\n", -1), zero, step, lambda acc: acc["out"])


def entropy(s: Column) -> Column:
    """Shannon entropy in bits for each character."""
    n = F.length(s)
    p = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(s, "")), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - p(c) * F.log2(p(c)))


SHELL_SPECIAL = "[ \\t\\n'\"\\\\$`]"


def shell_quote(s: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(s == "", F.lit("''")).when(~s.rlike(SHELL_SPECIAL), s).otherwise(quoted)


def shell_unquote(s: Column) -> Column:
    """What shell_quote made s from; null if it's no single word of that kind."""
    inner = F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.lit("'\\''"), F.lit("'"))
    return F.when(s.rlike(r"\A'[^']*(?:'\\''[^']*)*'\z"), inner).when((s != "") & ~s.rlike(SHELL_SPECIAL), s)


def wrap_command(runner: str, command: Column, stream: Column) -> Column:
    """A command as the argument of a redacting runner."""
    sub = F.when(stream, F.lit(" run --stream -- bash -c ")).otherwise(F.lit(" run -- bash -c "))
    return F.concat(shell_quote(F.lit(runner)), sub, shell_quote(command))


def unwrap_command(runner: str, wrapped: Column) -> Column:
    """The command that wrap_command wrapped; null if it isn't exactly of that form."""
    head = "\\Q" + ("'" + runner + "'" if " " in runner else runner) + "\\E"
    inner = F.regexp_extract(wrapped, rf"(?s)\A{head} run(?: --stream)? -- bash -c (.*)\z", 1)
    return F.when(inner != "", shell_unquote(inner))


def already_wrapped(runner: str, command: Column) -> Column:
    plain, quoted = runner, "'" + runner.replace("'", "'\\''") + "'"
    return command.startswith(f"{plain} run ") | command.startswith(f"{quoted} run ") | command.startswith(f'"{plain}" run ')


def split_language(s: Column) -> Column:
    """(prefix, rest) of text such as "python:command"."""
    prefix = F.regexp_extract(s, r"\A([a-z]+:)", 1)
    return F.struct(prefix.alias("prefix"), F.substring(s, F.length(prefix) + 1, F.length(s)).alias("rest"))


def short_hash(h: Column) -> Column:
    return F.when(F.coalesce(h, F.lit("")) == "", F.lit('""')).when(F.length(h) > 12, F.concat(F.left(h, F.lit(12)), F.lit("…"))).otherwise(h)


def short_path(p: Column) -> Column:
    return F.when(F.length(p) > 30, F.regexp_extract(p, r"([^/]*)\z", 1)).otherwise(p)


def hint(tool: str, rules: Column) -> Column:
    """A line that tells which rules fired; null without any."""
    return F.when(F.size(rules) > 0, F.concat(F.lit(f"[{tool}] redacted "), F.size(rules).cast("string"), F.lit(" secret(s) ("), F.array_join(rules, ", "), F.lit(")")))
