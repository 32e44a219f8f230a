"""Rule catalog: packs in layers, later layers override by id, with provenance.

A rule has a regex in RE2 syntax (its secret is group 1, or the match if there is none), keywords one of which must
be in the lower-cased text, a discard filter and line allowlists. The catalog is a short
list on the driver from which operators generate column expressions.
"""

from __future__ import annotations

import ast
import re
import tomllib
from dataclasses import dataclass, replace
from importlib import resources
from pathlib import Path
from re import _parser

#: Layers in order; a later one wins.
LAYERS = ("upstream", "embedded", "user", "project", "env")
MAX_REPEAT, MAX_PARENTS = 1000, 8
CONFIG_NAME = ".veilspark.toml"


@dataclass(frozen=True)
class Rule:
    id: str
    regex: str
    description: str = ""
    keywords: tuple[str, ...] = ()
    entropy: float | None = None
    filter: str = ""
    allow: tuple[str, ...] = ()
    source: str = "embedded"
    path: str = ""
    disabled: bool = False
    overridden_from: str = ""

    @property
    def overridden(self) -> bool:
        return bool(self.overridden_from)


class BadRule(ValueError):
    pass


_REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")


def check(rule: Rule) -> None:
    """BadRule if the rule can't be used as RE2 would use it."""
    if not rule.id or not rule.regex:
        raise BadRule(f"{rule.id or 'a rule'}: id and regex are needed")
    for m in _REPEAT.finditer(rule.regex):
        if any(int(x) > MAX_REPEAT for x in m.groups() if x):
            raise BadRule(f"{rule.id}: repeats over {MAX_REPEAT}")
    if re.search(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]", rule.regex):
        raise BadRule(f"{rule.id}: look-around, atomic groups and back references aren't RE2")
    try:
        re.compile(made := to_python(rule.regex), re.ASCII)
        if wrong := backtracking(made):
            raise BadRule(f"{rule.id}: {wrong}")
        for x in rule.allow:
            re.compile(to_python(x), re.ASCII)
        parse_filter(rule.filter)
    except (re.error, ValueError) as e:
        raise BadRule(f"{rule.id}: {e}") from e


#: Repeats up to this often can't multiply much.
_FEW = 4


def backtracking(regex: str) -> str:
    """Why a regex can take exponential or many times the text's length of time, or match nothing; "" if it can't. Decided on the parse tree.

    What's repeated many times must not itself be able to match in several ways: no part of it may vary in length
    unless what follows the part, in the same turn, can't begin as the part goes on; and of alternatives no two may begin alike.
    """
    # an empty look-ahead keeps the parser from making a class of alternatives, which Java doesn't
    tree = _parser.parse(re.sub(r"\\.|\|", lambda m: "|(?=)" if m[0] == "|" else m[0], regex, flags=re.DOTALL), re.ASCII)
    if tree.getwidth()[0] == 0:
        return "it can match nothing"
    return _nested(tree)


def _nested(tree) -> str:
    for op, value in tree:
        name = str(op)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = value
            if high > _FEW and high > low and (wrong := _several_ways(body)):
                return wrong
            if wrong := _nested(body):
                return wrong
        elif name == "SUBPATTERN":
            if wrong := _nested(value[-1]):
                return wrong
        elif name == "BRANCH":
            for branch in value[1]:
                if wrong := _nested(branch):
                    return wrong
        elif name in ("ASSERT", "ASSERT_NOT"):
            if wrong := _nested(value[1]):
                return wrong
    return ""


def _several_ways(body) -> str:
    """Why a turn of a repeat can match one text in several ways."""
    flat = _flat(body)
    if len(flat) == 1 and str(flat[0][0]) == "BRANCH":
        words = [_word(b) for b in flat[0][1][1]]
        if None not in words:  # plain words are ambiguous only where one begins with another
            alike = any(a.startswith(b) or b.startswith(a) for k, a in enumerate(words) for b in words[:k])
            return "alternatives that begin alike are repeated, which can take exponential time here" if alike else ""
        firsts = [_first(b) for b in flat[0][1][1]]
        if any(a & b for k, a in enumerate(firsts) for b in firsts[:k]):
            return "alternatives that begin alike are repeated, which can take exponential time here"
        return next((w for b in flat[0][1][1] if (w := _several_ways(b))), "")
    for k, (op, value) in enumerate(flat):
        if str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] != value[1]:
            # the next part, or the first one of the next turn, must show where this one ends
            after = _first(flat[k + 1 :] + flat)
            if _first(_flat(value[2])) & after or _several_ways(value[2]):
                return "nested quantifiers can take exponential time here"
    return ""


def _word(tree) -> str | None:
    """The one text that a sequence matches, if it's such, in lower case."""
    flat = [x for x in _flat(tree) if str(x[0]) != "ASSERT"]
    return "".join(chr(v).lower() for _, v in flat) if all(str(op) == "LITERAL" for op, _ in flat) else None


def _flat(tree) -> list:
    """A sequence without the brackets of its groups."""
    out = []
    for op, value in tree:
        out += _flat(value[-1]) if str(op) == "SUBPATTERN" else [(op, value)]
    return out


_EVERY = frozenset(range(129))  # 128 stands for all beyond ASCII


def _first(items) -> frozenset:
    """Characters that a sequence can begin with."""
    found: frozenset = frozenset()
    for op, value in items:
        name = str(op)
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if name == "LITERAL":
            return found | _folded(value)
        if name == "NOT_LITERAL":
            return found | (_EVERY - _folded(value))
        if name == "IN":
            return found | _in(value)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            found |= _first(_flat(value[2]))
            if value[0] == 0:
                continue
            return found
        if name == "SUBPATTERN":
            found |= _first(_flat(value[-1]))
            if value[-1].getwidth()[0] == 0:
                continue
            return found
        if name == "BRANCH":
            for b in value[1]:
                found |= _first(_flat(b))
            if any(b.getwidth()[0] == 0 for b in value[1]):
                continue
            return found
        return _EVERY  # anything else
    return found


def _folded(code: int) -> frozenset:
    return frozenset({128 if ord(c) > 127 else ord(c) for c in (chr(code).lower(), chr(code).upper()) if len(c) == 1})


def _in(parts) -> frozenset:
    found: set = set()
    for op, value in parts:
        name = str(op)
        if name == "LITERAL":
            found |= _folded(value)
        elif name == "RANGE":
            found |= {x for c in range(value[0], min(value[1], 127) + 1) for x in _folded(c)} | ({128} if value[1] > 127 else set())
        elif name == "CATEGORY":
            held = {c for c in range(128) if re.match({"DIGIT": r"\d", "SPACE": r"\s", "WORD": r"\w"}[str(value).split("_")[-1]], chr(c), re.ASCII)}
            found |= _EVERY - held if "_NOT_" in str(value) else held
    return _EVERY - (found - {128}) if parts and str(parts[0][0]) == "NEGATE" else frozenset(found)


def parse_pack(text: str, source: str = "env", path: str = "") -> tuple[list[Rule], list[str]]:
    """Rules of a TOML pack in order, and what was wrong with those left out. ValueError if it isn't TOML."""
    rules, wrong = [], []
    for r in tomllib.loads(text).get("rules", []):
        allow = tuple(x for a in r.get("allowlists", []) if a.get("regexTarget", "line") == "line" for x in a.get("regexes", []))
        rule = Rule(r.get("id", ""), r.get("regex", ""), r.get("description", ""), tuple(k.lower() for k in r.get("keywords", [])), r.get("entropy"), r.get("filter", ""), allow, source, path)
        try:
            check(rule)
        except BadRule as e:
            wrong.append(str(e))
        else:
            rules.append(rule)
    return rules, wrong


def builtin(name: str, source: str = "embedded") -> list[Rule]:
    return parse_pack((resources.files("veilspark.packs") / f"{name}.toml").read_text(), source, f"{name}.toml")[0]


@dataclass(frozen=True)
class Catalog:
    rules: tuple[Rule, ...]  # effective, in the order that findings are applied in
    listed: tuple[Rule, ...]  # with disabled ones, in listing order
    warnings: tuple[str, ...] = ()
    #: Globs of paths that the project has passed over, besides the built-in ones; for policy.Settings.skip.
    skip_paths: tuple[str, ...] = ()

    def frame(self, spark):
        """The listing as a DataFrame: source, rule_id, description, state, overridden_from, source_path."""
        rows = [(r.source, r.id, r.description, "disabled" if r.disabled else f"overrides {r.overridden_from}" if r.overridden else "active", r.overridden_from, r.path) for r in self.listed]
        return spark.createDataFrame(rows, "source string, rule_id string, description string, state string, overridden_from string, source_path string")


def skip_paths(text: str) -> tuple[str, ...]:
    """The skip patterns of a project's TOML file. ValueError if it isn't TOML, or they aren't a list of strings."""
    found = tomllib.loads(text).get("skip_paths", [])
    if not isinstance(found, list) or not all(isinstance(p, str) for p in found):
        raise ValueError("skip_paths isn't a list of strings")
    return tuple(found)


def compose(layers: dict[str, list[Rule]], disabled: set[str] = frozenset(), warnings: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> Catalog:
    """Merges layers: a rule overrides an earlier one of its id in place, new ids follow in order. Disabled ids are listed but not effective."""
    merged: dict[str, Rule] = {}
    for layer in LAYERS:
        for r in layers.get(layer, []):
            before = merged.get(r.id)
            merged[r.id] = replace(r, source=layer, overridden_from=before.source if before and before.source != layer else before.overridden_from if before else "")
    every = [replace(r, disabled=r.id in disabled) for r in merged.values()]
    listed = sorted(every, key=lambda r: (LAYERS.index(r.source), r.id))
    return Catalog(tuple(r for r in every if not r.disabled), tuple(listed), warnings, skip)


def load(user_dir: str | None = None, project_start: str | None = None, env_packs: tuple[str, ...] = (), disabled: set[str] = frozenset(), pii: bool = False) -> Catalog:
    """The effective catalog from all sources. A source that can't be parsed is left out with a warning."""
    layers: dict[str, list[Rule]] = {"embedded": builtin("core") + (builtin("pii") if pii else [])}
    warnings: list[str] = []

    def take(layer: str, path: Path) -> None:
        try:
            rules, wrong = parse_pack(path.read_text(), layer, str(path))
        except (OSError, ValueError) as e:
            warnings.append(f"{path}: {e}")
            return
        layers.setdefault(layer, []).extend(rules)
        warnings.extend(f"{path}: {w}" for w in wrong)

    for p in user_packs(user_dir):
        take("user", p)
    skip: tuple[str, ...] = ()
    if project_start and (config := project_config(project_start)):
        take("project", config)
        try:
            skip = skip_paths(config.read_text())
        except (OSError, ValueError) as e:
            warnings.append(f"{config}: skip_paths: {e}")
    for p in env_packs:
        take("env", Path(p))
    return compose(layers, disabled, tuple(warnings), skip)


def user_packs(folder: str | None) -> list[Path]:
    return sorted(Path(folder).glob("*.toml")) if folder and Path(folder).is_dir() else []


def project_config(start: str) -> Path | None:
    """The nearest config file in start or up to MAX_PARENTS - 1 folders above."""
    here = Path(start).resolve()
    for folder in [here, *here.parents][:MAX_PARENTS]:
        if (folder / CONFIG_NAME).is_file():
            return folder / CONFIG_NAME
    return None


def project_warning(catalog: Catalog, skip_paths: tuple[str, ...] = ()) -> tuple[list[str], int]:
    """Ids that the project overrides, in order, and how many ids and skip patterns (the catalog's, and others given) it brings."""
    ids = sorted(r.id for r in catalog.listed if r.source == "project" and r.overridden)
    return ids, len(ids) + len(catalog.skip_paths) + len(skip_paths)


# RE2 in other dialects ---------------------------------------------------------------

_BOUNDARY = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


#: RE2's named classes.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_NOT_POSIX = {
    "alnum": r"\x00-/:-@\[-`{-\U0010FFFF", "alpha": r"\x00-@\[-`{-\U0010FFFF", "blank": r"\x00-\x08\x0A-\x1F!-\U0010FFFF", "digit": r"\x00-/:-\U0010FFFF", "lower": r"\x00-`{-\U0010FFFF",
    "space": r"\x00-\x08\x0E-\x1F!-\U0010FFFF", "upper": r"\x00-@\[-\U0010FFFF", "word": r"\x00-/:-@\[-^`{-\U0010FFFF",
}
_FLAGS = re.compile(r"\(\?([a-zA-Z-]*)([:)])")
_CODE = re.compile(r"\\x\{([0-9A-Fa-f]+)\}")


def _named_class(name: str) -> str:
    table, key = (_NOT_POSIX, name[1:]) if name.startswith("^") else (POSIX, name)
    if key not in table:
        raise ValueError(f"this class isn't known: [:{name}:]")
    return table[key]


def _class(rx: str, k: int) -> tuple[str, int]:
    """A bracketed class that begins at k, for Java and Python alike, and where it ends."""
    out, k = "[", k + 1
    if rx[k : k + 1] == "^":
        out, k = "[^", k + 1
    first = True
    while first or rx[k : k + 1] != "]":
        if k >= len(rx):
            raise ValueError("a class isn't closed")
        first = False
        if rx.startswith("[:", k) and (end := rx.find(":]", k)) > 0:
            out, k = out + _named_class(rx[k + 2 : end]), end + 2
        elif rx[k] == "\\":
            m = _CODE.match(rx, k)
            t = m[0] if m else rx[k : k + 2]
            out, k = out + (_point(m[1]) if m else {r"\s": r"\t\n\f\r ", r"\S": r"\x00-\x08\x0B\x0E-\x1F!-\U0010FFFF", r"\v": r"\x0B"}.get(t, t)), k + len(t)
        else:
            out, k = out + ("\\" + rx[k] if rx[k] in "[]&~|" else rx[k]), k + 1
    return out + "]", k + 1


def _point(code: str) -> str:
    return rf"\U{int(code, 16):08X}"


def _rewritten(rx: str, java: bool) -> str:
    """An RE2 regex in another dialect. Flags m and s are worked into what they act on; ValueError for what only RE2 has."""
    out, k = [], 0
    depth: list[tuple[dict, int]] = []
    flags = {"i": False, "m": False, "s": False}
    opened, begins = 0, True  # groups that a flag opened at this depth; whether nothing has come at this depth yet
    while k < len(rx):
        c, was, begins = rx[k], begins, False
        if c == "\\":
            m = _CODE.match(rx, k)
            t = m[0] if m else rx[k : k + 2]
            k += len(t)
            if m:
                t = _point(m[1])
            elif t in (r"\Q", r"\E", r"\C", r"\p", r"\P", r"\R", r"\X", r"\h", r"\H", r"\V", r"\G", r"\Z", r"\K", r"\N", r"\k"):
                raise ValueError(f"{t} isn't taken")
            out.append({r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]", r"\b": _BOUNDARY, r"\B": f"(?!{_BOUNDARY})", r"\v": r"\x0B"}.get(t, t))
        elif c == "[":
            t, k = _class(rx, k)
            out.append(t)
        elif c == "(":
            m = _FLAGS.match(rx, k)
            name = re.match(r"\(\?P?<[A-Za-z_]\w*>", rx[k:])
            if m and m[2] == ")":
                on, _, off = m[1].partition("-")
                if set(on + off) - set("ims"):
                    raise ValueError(f"{m[0]} isn't taken")
                before = flags["i"]
                flags = flags | dict.fromkeys(on, True) | dict.fromkeys(off, False)
                if flags["i"] != before:
                    if java:
                        out.append("(?iu)" if flags["i"] else "(?-iu)")
                    else:
                        out.append("(?i:" if flags["i"] else "(?-i:")
                        opened += 1
                        if not was and "|" in _rest_of_group(rx[m.end() :]):
                            raise ValueError("a flag amid alternatives isn't taken")
                k, begins = m.end(), was
            else:
                depth.append((flags, opened))
                opened, begins = 0, True
                if m:
                    on, _, off = m[1].partition("-")
                    if set(on + off) - set("ims"):
                        raise ValueError(f"{m[0]} isn't taken")
                    before = flags["i"]
                    flags = flags | dict.fromkeys(on, True) | dict.fromkeys(off, False)
                    out.append("(?:" if flags["i"] == before else ("(?iu:" if java else "(?i:") if flags["i"] else ("(?-iu:" if java else "(?-i:"))
                    k = m.end()
                elif name:
                    out.append("(")
                    k += name.end()
                else:
                    out.append("(")
                    k += 1
        elif c == ")":
            out.append(")" * (opened + 1))
            if not depth:
                raise ValueError("a bracket isn't opened")
            flags, opened = depth.pop()
            k += 1
        else:
            if c == ".":
                c = r"[\x00-\U0010FFFF]" if flags["s"] else r"[^\n]"
            elif c == "$":
                c = (r"(?=\n|\z)" if flags["m"] else r"\z") if java else r"(?=\n|\Z)" if flags["m"] else r"\Z"
            elif c == "^":
                c = r"(?<![^\n])" if flags["m"] else r"\A"
            out.append(c)
            k += 1
    out.append(")" * opened)
    made = "".join(out)
    return re.sub(r"\\U([0-9A-F]{8})", lambda m: rf"\x{{{int(m[1], 16):X}}}", made) if java else made.replace(r"\z", r"\Z")


def _rest_of_group(rx: str) -> str:
    """What follows in the same group, less what's in brackets."""
    out, level, k = [], 0, 0
    while k < len(rx):
        if rx[k] == "\\":
            k += 2
            continue
        if rx[k] == "[":
            k = _class(rx, k)[1]
            continue
        level += (rx[k] == "(") - (rx[k] == ")")
        if level < 0:
            break
        if not level:
            out.append(rx[k])
        k += 1
    return "".join(out)


def to_java(rx: str) -> str:
    """An RE2 regex for java.util.regex with the same matches."""
    return _rewritten(rx, True)


def to_python(rx: str) -> str:
    """An RE2 regex for re with re.ASCII and the same matches, but for case folding beyond ASCII."""
    return _rewritten(rx, False)


# Discard filters ------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    kind: str  # entropy: at most `limit`; any: one of `values` matches; contains: one of `values` is contained
    limit: float = 0.0
    values: tuple[str, ...] = ()


_SECRET = r'finding\["secret"\]'
_TERMS = re.compile(rf'\s*(?:entropy\({_SECRET}\)\s*(<=|<)\s*([0-9.]+)|(matchesAny|containsAny)\({_SECRET},\s*(\[(?:\s*"(?:[^"\\]|\\.)*"\s*,?)*\s*\])\s*\))\s*')


def parse_filter(text: str) -> list[Term]:
    """Terms of a filter, one of which must hold to discard a finding. ValueError for others."""
    terms, at = [], 0
    while text.strip() and at < len(text):
        m = _TERMS.match(text, at)
        if not m:
            raise ValueError(f"this filter isn't known: {text[at : at + 60]!r}")
        terms.append(Term("entropy", float(m[2])) if m[1] else Term("any" if m[3] == "matchesAny" else "contains", values=tuple(ast.literal_eval(m[4]))))
        at = m.end()
        if at < len(text):
            if text[at : at + 2] != "||":
                raise ValueError(f"this filter isn't known: {text[at : at + 60]!r}")
            at += 2
    return terms


def terms_of(rule: Rule) -> list[Term]:
    return parse_filter(rule.filter) + ([Term("entropy", rule.entropy)] if rule.entropy is not None else [])
