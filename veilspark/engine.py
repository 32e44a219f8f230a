"""The whole redaction of one string, for the texts that native expressions can't finish.

Column expressions cover surface matches, two levels of decoding and views of obfuscated lines
(operators/deep.py). What they can't unroll is deeper decoding and the rewriting of trees of
unknown shape; those texts, and only those, pass an Arrow UDF that runs this module.
"""

from __future__ import annotations

import binascii
import html
import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from json.encoder import encode_basestring
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

from veilspark.catalog import Rule, terms_of, to_python
from veilspark.functions.text import ANSI, ENTITY, HEX_RUN, INVISIBLE, TAIL_BYTES
from veilspark.operators.decode import BASE64, CODE, HEX, HEXED, MAY_BE_ENCODED, PERCENT, UNICODE
from veilspark.operators.detect import ALPHABET, MARKER_BYTES, MARKERS, ONE_LETTER, SHORT_BYTES

DECODE_DEPTH, TREE_DEPTH = 8, 64
_ANSI, _ENTITY, _HEX_RUN = re.compile(ANSI), re.compile(ENTITY), re.compile(HEX_RUN)
_ONE_LETTER = re.compile(ONE_LETTER.replace(r"\z", r"\Z"), re.ASCII)
_INVISIBLE = dict.fromkeys(INVISIBLE)
_BASE64, _HEX, _HEXED, _PERCENT, _CODE = (re.compile(p) for p in (BASE64, HEX, HEXED, PERCENT, CODE))
_UNICODE = [re.compile(p) for p in UNICODE]
_PRINTABLE = bytes([9, 10, 13, *range(32, 127)])
#: Texts without any of these, and without a rule's keyword, hold nothing to find.
_HIDING = re.compile(f"{MAY_BE_ENCODED}|{HEX_RUN[4:].replace('a-f', 'a-fA-F')}|{ENTITY}|[\x1b{''.join(map(chr, INVISIBLE))}]")
#: Lines without any of these have no view that differs.
_VIEWED = re.compile(f"{HEX_RUN[4:].replace('a-f', 'a-fA-F')}|{ENTITY}|[{''.join(map(chr, INVISIBLE))}]")
_ENCODED = re.compile(MAY_BE_ENCODED)
#: A string of a JSON text, and the colon after it if it's a key.
_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"(?:[ \t\n\r]*(:))?', re.DOTALL)
#: What a JSON text is cut at.
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],:]', re.DOTALL)


class Finding(NamedTuple):
    rule_id: str
    match: str
    secret: str
    #: What stands in the text in place of a decoded match.
    encoded: str = ""

    @property
    def forms(self) -> tuple[str, ...]:
        if self.encoded:
            return (self.encoded,)
        if self.match == self.secret or not self.secret:
            return (self.match,) if self.match else ()
        return (self.match, self.secret) if self.match else (self.secret,)


def utf8(s: str) -> bytes:
    """A string's bytes; JSON may bring halves of surrogate pairs, which UTF-8 hasn't."""
    return s.encode("utf-8", "surrogatepass")


def whole(s: str) -> str:
    """s with a replacement character for each half of a surrogate pair."""
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def strip_ansi(s: str) -> str:
    return _ANSI.sub("", s) if "\x1b" in s else s


def placeholder(f: Finding) -> str:
    secret = f.secret or f.match
    tail = f":{secret[-4:]}" if len(secret) >= TAIL_BYTES or len(utf8(secret)) >= TAIL_BYTES else ""
    return f"<REDACTED:{f.rule_id.lower().replace(' ', '-') or 'secret'}{tail}>"


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def views(line: str) -> list[str]:
    if not _VIEWED.search(line):
        return []
    every = [line.translate(_INVISIBLE), _HEX_RUN.sub(lambda m: re.sub("[-: ]", "", m[0]), line), _ENTITY.sub(lambda m: html.unescape(m[0]), line)]
    return [v for v in dict.fromkeys(every) if v != line]


def survives(text: str, form: str) -> bool:
    if form not in text:
        return False
    return len(utf8(form)) > SHORT_BYTES or re.search(rf"(?<![A-Za-z0-9_-]){re.escape(form)}(?![A-Za-z0-9_-])", text) is not None


def leaks(text: str, forms: Sequence[str]) -> bool:
    for f in forms:
        if f in text and survives(text, f):
            return True
    return "\x1b" in text and any(survives(strip_ansi(text), f) for f in forms)


def _printable(raw: bytes) -> str | None:
    return raw.decode("ascii") if raw and not raw.translate(None, _PRINTABLE) else None



def _from_base64(s: str) -> bytes:
    raw = s.rstrip("=")
    if "-" in raw or "_" in raw:
        raw = raw.replace("-", "+").replace("_", "/")
    try:  # the pattern leaves nothing to validate but the length
        return binascii.a2b_base64(raw + "=" * (-len(raw) % 4))
    except binascii.Error:
        return b""


def _from_codes(s: str) -> bytes:
    codes = [int(x, 16) for x in _CODE.findall(s)]
    return bytes(codes) if max(codes) < 127 else b""


def decodings(text: str) -> list[tuple[str, str]]:
    """(segment, decoded) for the segments of text that decode to printable ASCII; in time linear in the text."""
    if not _ENCODED.search(text):
        return []
    out = []
    made = [(s, _from_base64(s)) for s in _BASE64.findall(text)]
    if made and _HEXED.search(text):  # a run of hex digits lies in one of base64
        made += [(s, bytes.fromhex(s)) for s in _HEX.findall(text) if len(s) % 2 == 0]
    if "%" in text:
        made += [(m[0], unquote_to_bytes(m[0])) for m in _PERCENT.finditer(text)]
    if "\\u" in text or "U+" in text:
        made += [(m[0].rstrip(" "), _from_codes(m[0])) for p in _UNICODE for m in p.finditer(text)]
    for segment, raw in made:
        if (got := _printable(raw)) and got != segment:
            out.append((segment, got))
    return out


#: Findings of a text from which on they're looked for together.
MANY = 16


class Forms:
    """Many strings that are looked for in a text at once: at each place by their first characters, then by the lengths that such ones have."""

    def __init__(self, forms):
        self.known = set(forms)
        self.head = min(8, min(map(len, self.known)))
        self.lengths: dict[str, set[int]] = {}
        for x in self.known:
            self.lengths.setdefault(x[: self.head], set()).add(len(x))

    def within(self, s: str) -> set[str]:
        """Those that s holds."""
        h, lengths, known = self.head, self.lengths, self.known
        return {x for k in range(len(s) - h + 1) if (of := lengths.get(s[k : k + h])) for n in of if (x := s[k : k + n]) in known}


@dataclass
class Engine:
    rules: Sequence[Rule]
    markers: Sequence[str] = MARKERS
    depth: int = DECODE_DEPTH
    suppressed: list[str] = field(default_factory=list)
    #: Results for strings seen lately; trees are read more than once and repeat values.
    memo: int = 4096

    def __post_init__(self) -> None:
        self._memo: dict[tuple[str, bool], tuple[str, tuple[str, ...]]] = {}
        gates = [k for r in self.rules for k in r.keywords]
        self._gated = re.compile("" if any(not r.keywords for r in self.rules) else "|".join(map(re.escape, gates)) or r"(?!)")
        self._compiled = [(r, re.compile(to_python(r.regex), re.ASCII), [(t, [re.compile(to_python(v), re.ASCII) for v in t.values] if t.kind == "any" else t.values) for t in terms_of(r)], [re.compile(to_python(x), re.ASCII) for x in r.allow]) for r in self.rules]

    def _dropped(self, terms, secret: str) -> bool:
        return any(entropy(secret) <= t.limit if t.kind == "entropy" else any(v.search(secret) for v in values) if t.kind == "any" else any(v in secret for v in values) for t, values in terms)

    def matches(self, text: str) -> Iterator[tuple[int, int, Finding]]:
        """Where each surface finding begins and ends, in order of rules and places; judged by the lines that it lies on."""
        low = text.lower()
        for rule, regex, terms, allow in self._compiled:
            if rule.keywords:
                for k in rule.keywords:
                    if k in low:
                        break
                else:
                    continue
            groups = regex.groups
            for m in regex.finditer(text):
                secret = (m[1] if groups else None) or m[0]
                if ALPHABET in secret or _ONE_LETTER.match(secret) or terms and self._dropped(terms, secret):
                    continue
                if allow:
                    start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
                    if any(a.search(text[start : end if end >= 0 else len(text)]) for a in allow):
                        continue
                yield m.start(), m.end(), Finding(rule.id, m[0], secret)

    def surface(self, text: str, marked: bool = False) -> list[Finding]:
        """Findings in order of rules, one for each occurrence; marked: without those near a marker, which are noted as suppressed."""
        out = []
        marked = marked and self._marked(text)
        for start, end, f in self.matches(text):
            if marked and self._near(text, start, end):
                self.suppressed.append(f.rule_id)
            else:
                out.append(f)
        return out

    def find(self, text: str, authored: bool = False) -> list[Finding]:
        """Findings of the text, then of what its segments decode to, to the depth."""
        authored = authored and self._marked(text)
        out = self.surface(text, authored)
        level = decodings(text)
        for _ in range(self.depth):
            deeper = []
            for segment, got in level:
                found = self.surface(got)
                if found and authored and self._near_everywhere(text, segment):
                    self.suppressed += [f.rule_id for f in found]
                else:
                    out += [Finding(f.rule_id, f.match, f.secret, segment) for f in found]
                deeper += [(segment, more) for _, more in decodings(got)]
            level = deeper
            if not level:
                break
        return list(dict.fromkeys(out)) if len(out) > 1 else out

    def _marked(self, text: str) -> bool:
        """Whether a text holds a marker at all; where it doesn't, none is near anything."""
        for m in self.markers:
            if m in text:
                return True
        return False

    def _near(self, text: str, start: int, end: int) -> bool:
        """Whether a marker is near the first occurrence of text[start:end] on its lines."""
        match = text[start:end]
        a = text.find(match, text.rfind("\n", 0, start) + 1)
        left = max(text.rfind("\n", 0, a) + 1, a - MARKER_BYTES)
        line = text.find("\n", a, a + len(match) + MARKER_BYTES)
        right = line if line >= 0 else a + len(match) + MARKER_BYTES
        before = utf8(text[left:a])[-MARKER_BYTES:]
        after = utf8(text[a + len(match) : right])[:MARKER_BYTES]
        around = before + utf8(text[a : min(a + len(match), right)]) + after
        return any(m.encode() in around for m in self.markers)

    def _near_everywhere(self, text: str, segment: str) -> bool:
        """Whether all lines that hold a segment have a marker near it."""
        at = text.find(segment)
        while at >= 0:
            if not self._near(text, at, at + len(segment)):
                return False
            end = text.find("\n", at + len(segment))
            at = text.find(segment, end) if end >= 0 else -1
        return True

    def splice(self, text: str, found: list[Finding]) -> str:
        if len(found) >= MANY and (out := self._splice_many(text, found)) is not None:
            return out
        for f in found:
            ph = placeholder(f)
            text = text.replace(f.encoded or f.match, ph)
            if leaks(text, f.forms):
                text = "\n".join(ph if leaks(line, f.forms) else line for line in text.split("\n"))
                if leaks(text, f.forms):
                    text = ph
        return text

    def _splice_many(self, text: str, found: list[Finding]) -> str | None:
        """The same in time linear in the text, line by line; None where lines or findings may act on one another.

        A form without <, > and line ends can only come to be inside of a placeholder. So on each line just those findings
        count, in their order, that it holds, and those that their placeholders hold.
        """
        if "\x1b" in text or any(c in x for f in found for x in f.forms for c in "<>\n\x1b"):
            return None
        by: dict[str, list[int]] = {}
        for k, f in enumerate(found):
            for x in f.forms:
                by.setdefault(x, []).append(k)
        forms = Forms(by)
        marks: dict[int, tuple[str, set[int]]] = {}
        of = lambda s: {k for x in forms.within(s) for k in by[x]}
        out = []
        for line in text.split("\n"):
            todo = of(line)
            new = todo
            while new:
                for k in new:
                    if k not in marks:
                        ph = placeholder(found[k])
                        marks[k] = ph, of(ph)
                new = {j for k in new for j in marks[k][1]} - todo
                todo = todo | new
            for k in sorted(todo):
                f, ph = found[k], marks[k][0]
                line = line.replace(f.encoded or f.match, ph)
                if leaks(line, f.forms):
                    line = ph
                    if leaks(line, f.forms):  # then the whole text goes
                        return None
            out.append(line)
        return "\n".join(out)

    def gone(self, text: str, found: list[Finding]) -> list[str]:
        """Ids of findings that a text doesn't hold any more."""
        if len(found) >= MANY and "\x1b" not in text:
            left = Forms(x for f in found for x in f.forms).within(text)
            return list(dict.fromkeys(f.rule_id for f in found if not any(x in left and survives(text, x) for x in f.forms)))
        return list(dict.fromkeys(f.rule_id for f in found if not leaks(text, f.forms)))

    def redact_surface(self, text: str, authored: bool = False) -> tuple[str, list[str]]:
        """Redacted text and ids by surface matches alone."""
        found = list(dict.fromkeys(self.surface(strip_ansi(text), authored)))
        out = self.splice(text, found)
        return (out, self.gone(out, found)) if out != text else (text, [])

    def redact(self, text: str, authored: bool = False) -> tuple[str, list[str]]:
        """Redacted text and the ids of rules whose secrets are gone; no ids if nothing changed."""
        if not text:
            return text, []
        if (text, authored) not in self._memo:
            if len(self._memo) >= self.memo:
                self._memo.clear()
            out, ids = self._redact(text, authored)
            self._memo[text, authored] = out, tuple(ids)
        out, ids = self._memo[text, authored]
        return out, list(ids)

    def _redact(self, text: str, authored: bool) -> tuple[str, list[str]]:
        if not _HIDING.search(text) and not self._gated.search(text.lower()):
            return text, []
        found = self.find(strip_ansi(text), authored)
        out = self.splice(text, found)
        ids = self.gone(out, found)
        if "\x1b" not in out and not _VIEWED.search(out):
            return (out, ids) if out != text else (text, [])
        lines = out.split("\n")
        for k, line in enumerate(lines):
            hits = [f for v in views(strip_ansi(line)) for f in self.find(v, authored)]
            if hits:
                lines[k] = placeholder(hits[0])
                ids += [f.rule_id for f in hits if f.rule_id not in ids]
        out = "\n".join(lines)
        return (out, list(dict.fromkeys(ids))) if out != text else (text, [])

    # Trees -------------------------------------------------------------------------

    def _scanned(self, leaves: list[Leaf], authored: bool) -> list[tuple[Leaf, str, list[str]]]:
        """Leaves with findings, their redacted values and ids."""
        out = []
        for leaf in leaves:
            value, ids = self.redact(leaf.value, authored)
            if ids:
                out.append((leaf, value, ids))
        return out

    def _scanned_flat(self, text: str, tree, authored: bool) -> list[tuple[Leaf, str, list[str]]]:
        """The same of a JSON text whose leaves lie within the depth; keys and numbers are looked up for leaves with findings alone."""
        found = []
        n, escaped = 0, "\\" in text
        for m in _STRING.finditer(text):
            if m[1] is None:
                start, end = m.span()
                value = _string(text[start:end]) if escaped else text[start + 1 : end - 1]
                out, ids = self.redact(value, authored)
                if ids:
                    found.append((n, start, end, value, out, ids))
                n += 1
        at = _places(tree, {n for n, *_ in found}) if found else {}
        return [(Leaf(start, end, value, *at[n]), out, ids) for n, start, end, value, out, ids in found]

    def first_hit(self, node, authored: bool = False) -> tuple[str, list[str]] | None:
        """Path and ids of the first hit of a tree in order of keys."""
        hits = self._scanned(sorted(json_leaves(json.dumps(node))[0], key=Leaf.order), authored)
        return (hits[0][0].path, hits[0][2]) if hits else None

    def all_hits(self, node, authored: bool = False) -> tuple[list[str], list[str]]:
        """Distinct ids and distinct paths in order of keys, the root's being (root)."""
        hits = self._scanned(sorted(json_leaves(json.dumps(node))[0], key=Leaf.order), authored)
        return list(dict.fromkeys(i for _, _, ids in hits for i in ids)), list(dict.fromkeys(leaf.path or "(root)" for leaf, _, _ in hits))

    def redact_tree(self, node, authored: bool = False) -> tuple[object, list[str]]:
        made = self.redact_json(json.dumps(node), "a" * authored)
        return json.loads(made["text"]), made["rules"]

    def redact_json(self, text: str, mode: str = "") -> dict:
        """A JSON text in one walk: text (unchanged if clean), rules, path and first (the first hit's path and ids), fields (all paths).

        Strings are put in place in the text, so all else stays as it's written. A text that isn't JSON is redacted as one
        string. mode holds any of: a (authored), u (a JSON string in a JSON string counts as the inner one), j (text that
        isn't JSON passes), f (a form: strings at the top alone, ids and fields sorted), s (the top's values apart: ids of
        each one after the other, and only changed ones in text).
        """
        authored = "a" in mode
        clean = {"text": text, "rules": [], "path": "", "first": [], "fields": []}
        try:
            tree = _checked(text)
            if "u" in mode and isinstance(tree, str):
                try:
                    tree, text = _checked(tree), tree
                except ValueError:
                    pass
        except (ValueError, RecursionError):
            if "j" in mode or "f" in mode:
                return clean
            out, ids = self.redact(text, authored)
            return clean | {"text": out, "rules": ids, "first": ids, "fields": ["(root)"]} if ids else clean
        if ("f" in mode or "s" in mode) and not text.lstrip(" \t\n\r").startswith("{"):
            return clean
        top: list = []
        if "f" in mode or "s" in mode or text.count("{") + text.count("[") > TREE_DEPTH:
            leaves, top = json_leaves(text)
            if "f" in mode:
                leaves = sorted((x for x in leaves if len(x.at) == 1), key=Leaf.order)
            hits = self._scanned(leaves, authored)
        else:
            hits = self._scanned_flat(text, tree, authored)
        if not hits:
            return clean
        if len(hits) == 1:
            (leaf, value, ids), path = hits[0], whole(hits[0][0].path)
            if "s" not in mode and "f" not in mode:
                return {"text": _put(text, hits, 0, len(text)), "rules": ids, "path": path, "first": ids, "fields": [path or "(root)"]}
        ids = list(dict.fromkeys(i for _, _, found in hits for i in found))
        if "f" in mode:
            ids.sort()
        if "s" in mode:
            of = {k: [i for i in dict.fromkeys(i for leaf, _, found in hits for i in found if a <= leaf.start < b)] for k, (_, a, b) in enumerate(top)}
            ids = [i for found in of.values() for i in found]
            out = "{" + ",".join(text[key.start() : key.end()] + ":" + _put(text, hits, a, b).strip() for k, (key, a, b) in enumerate(top) if of[k]) + "}"
        else:
            out = _put(text, hits, 0, len(text))
        ordered = sorted(hits, key=lambda h: h[0].order())
        fields = list(dict.fromkeys(whole(leaf.path) or "(root)" for leaf, _, _ in ordered))
        return {"text": out, "rules": ids, "path": whole(ordered[0][0].path), "first": ordered[0][2], "fields": fields}


def _constant(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


#: Objects are tuples of pairs, in which a repeated key stays.
_DECODER = json.JSONDecoder(parse_int=lambda _: 0, parse_float=lambda _: 0.0, parse_constant=_constant, object_pairs_hook=tuple)


def _checked(text: str):
    """A JSON text's value, but for its numbers; ValueError if it isn't JSON."""
    if text.startswith("\ufeff"):
        raise ValueError("a byte order mark isn't JSON")
    return _DECODER.decode(text)


def _string(written: str) -> str:
    """The value of a JSON string of a text that's JSON."""
    return json.loads(written) if "\\" in written else written[1:-1]


class Leaf(NamedTuple):
    """A string in a JSON text: where it's written, its value, keys and numbers that lead to it, and these as a path."""

    start: int
    end: int
    value: str
    at: tuple
    path: str

    def order(self) -> tuple:
        """Keys in their order; where a key is repeated, its values may be of different kinds."""
        return tuple((isinstance(x, str), x) for x in self.at)


def json_leaves(text: str) -> tuple[list[Leaf], list[tuple[re.Match, int, int]]]:
    """Strings of a JSON text up to the depth, in document order, keys excepted; and (key, start, end) of the values of an object at the top."""
    out: list[Leaf] = []
    top: list[tuple[re.Match, int, int]] = []
    stack: list[list] = []  # kind, key or number, path of the container
    key = None
    for m in _TOKEN.finditer(text):
        c = text[m.start()]
        now = stack[-1] if stack else None
        if c == '"':
            if now and now[0] == "{" and now[1] is None:
                now[1] = _string(m[0])
                if len(stack) == 1:
                    key = m
            elif len(stack) <= TREE_DEPTH:
                out.append(Leaf(m.start(), m.end(), _string(m[0]), tuple(x[1] for x in stack), _path(now)))
        elif c == ":":
            if len(stack) == 1:
                begin = m.end()
        elif c in "{[":
            stack.append([c, None if c == "{" else 0, _path(now)])
        else:
            if len(stack) == 1 and now[0] == "{" and now[1] is not None:
                top.append((key, begin, m.start()))
            if c == ",":
                now[1] = None if now[0] == "{" else now[1] + 1
            else:
                stack.pop()
    return out, top


def _path(now: list | None) -> str:
    if now is None:
        return ""
    kind, at, path = now
    return f"{path}[{at}]" if kind == "[" else f"{path}.{at}" if path else at


def _places(tree, wanted: set[int]) -> dict[int, tuple[tuple, str]]:
    """Keys and numbers that lead to the strings of a tree with the numbers wanted, in document order, and these as a path."""
    out, last, n = {}, max(wanted), 0
    todo: list = [(tree, None)]
    while n <= last:
        node, way = todo.pop()  # way: a key or number, and the way before it
        kind = type(node)
        if kind is str:
            if n in wanted:
                out[n] = _along(way)
            n += 1
        elif kind is tuple:
            todo += [(x, (k, way)) for k, x in reversed(node) if type(x) in _HOLDS]
        else:
            todo += [(node[k], (k, way)) for k in range(len(node) - 1, -1, -1) if type(node[k]) in _HOLDS]
    return out


#: Kinds of nodes that are strings or may hold such.
_HOLDS = frozenset((str, tuple, list))


def _along(way) -> tuple[tuple, str]:
    at: list = []
    while way is not None:
        k, way = way
        at.append(k)
    at.reverse()
    path = ""
    for k in at:
        path = (f"{path}.{k}" if path else k) if type(k) is str else f"{path}[{k}]"
    return tuple(at), path


def _put(text: str, hits: list[tuple[Leaf, str, list[str]]], start: int, end: int) -> str:
    """text[start:end] with the strings of hits in it replaced."""
    out = []
    for leaf, value, _ in hits:
        if start <= leaf.start < end:
            made = encode_basestring(value)
            out += [text[start : leaf.start], made if whole(made) == made else json.dumps(value)]
            start = leaf.end
    return "".join(out) + text[start:end]
