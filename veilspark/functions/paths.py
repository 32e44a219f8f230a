"""Globs as predicates: path skip lists and tool names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths of test material that are passed over.
SKIP = ("**/testdata/**", "**/fixtures/**", "**/__fixtures__/**", "**/cassettes/**", "**/tests/**", "**/test/**", "**/spec/**", "*_test.*", "test_*.py", "*.test.*", "*.spec.*", "*.fixture.*", "*.golden", "*.snap", "**/.veilspark/**")
#: Tools that stay on the machine, and built-in tools that don't.
LOCAL_TOOLS = ("bash", "read", "write", "edit", "apply_patch", "grep", "glob", "ls", "todoread", "todowrite", "task")
NETWORK_TOOLS = ("webfetch", "websearch")


def _segment(glob: str) -> str:
    """A glob without ** as a regex; its * and ? stay within a path segment."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            body = glob[k + 1 : end]
            out.append("[" + ("^" + re.escape(body[1:]) if body[0] == "^" else re.escape(body)).replace(r"\-", "-") + "]")
            k = end
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out.append(re.escape(glob[k]))
        else:
            out.append(re.escape(c))
        k += 1
    return "".join(out)


def glob_regex(glob: str) -> str:
    """One regex for a skip pattern. `**/` at the front and `/**` at the end match any depth; others match the whole path or its last part."""
    front, back = glob.startswith("**/"), glob.endswith("/**")
    if front and back:
        return rf"(?:\A|/){re.escape(glob[3:-3])}(?:/|\z)"
    if front:
        return rf"(?:{glob_regex(glob[3:])})|/{re.escape(glob[3:])}\z"
    if back:
        return rf"(?:\A|/){re.escape(glob[:-3])}(?:/|\z)"
    return rf"\A{_segment(glob)}\z|(?:\A|/){_segment(glob)}\z" if "/" not in glob else rf"\A{_segment(glob)}\z"


def skipped(path: Column, patterns: tuple[str, ...] = SKIP) -> Column:
    """Whether a path is on the skip list. Null and empty paths aren't."""
    regex = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return F.coalesce((path != "") & F.replace(path, F.lit("\\"), F.lit("/")).rlike(regex), F.lit(False))


def tool_matches(tool: Column, globs: tuple[str, ...]) -> Column:
    """Whether a tool's name matches a glob in which only * is special."""
    regexes = [r"(?s)\A" + ".*".join(re.escape(p) for p in g.strip().split("*")) + r"\z" for g in globs if g.strip()]
    return F.coalesce(tool.rlike("|".join(f"(?:{r})" for r in regexes)), F.lit(False)) if regexes else F.lit(False)


def sends_out(tool: Column) -> Column:
    """Whether a tool's input leaves the machine: network tools, and tools of other servers."""
    t = F.lower(tool)
    return F.when(t.isin(*NETWORK_TOOLS), True).when(t.isin(*LOCAL_TOOLS), False).otherwise(F.coalesce(t.contains("_"), F.lit(False)))


def write_shaped(key: Column) -> Column:
    return key.rlike(r"\Acontent\z|_(?:string|source)\z")


def of_server(tool: Column) -> Column:
    return tool.startswith("mcp__") | tool.startswith("MCP:")
