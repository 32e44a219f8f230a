"""Decisions on agent events: allow, deny, rewrite or observe.

An event is (harness, event, tool, payload): payload is JSON whose field names differ by
harness. A table of routes says, for each harness and event, what is scanned, as what kind
of text, and what a finding leads to. Rows are routed by one CASE, the chosen text is
scanned once by one UDF, and the decision is made from its result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.catalog import Rule
from veilspark.functions.paths import SKIP, of_server, sends_out, skipped, tool_matches, write_shaped
from veilspark.functions.text import already_wrapped, parse_json, wrap_command
from veilspark.operators.decode import let
from veilspark.operators.deep import surely_redacted
from veilspark.operators.redact import LONG_BYTES, tree_udf, worth_walking

PRIMING_MARK = "secret redaction is active in this session"
PRIMING = f"Note: {PRIMING_MARK}. Values shown as <REDACTED:...> were removed; refer to secrets by variable name."
BANNER = "[veilspark] paused: nothing is redacted or blocked"


@dataclass(frozen=True)
class Settings:
    runner: str = "veilspark"
    paused_until: str | None = None  # a time; while it's in the future nothing is scanned, and if it can't be read neither
    allow_tools: tuple[str, ...] = ()  # globs of tools whose output passes with a warning
    skip: tuple[str, ...] = ()
    warn_only: bool = False  # denials of writes, fetches and other servers' tools become warnings
    scan_output: bool = True  # off: tool output of claudecode passes
    copies: str = ""  # folder for redacted copies of files that are read; see sources.text.write_copies


@dataclass(frozen=True)
class Route:
    harness: str
    event: str
    when: str  # which tools: a name of TOOLS
    part: str  # what is scanned: a name of PARTS
    mode: str  # as what kind of text: see Engine.redact_json
    verdict: str  # deny, warn, rewrite, wrap, prime, observe
    field: str = ""  # what a finding is said to be in; "*" for all paths, "" for the first one's
    may_warn: bool = False  # Settings.warn_only applies
    log: str = ""  # the audit log's word for a finding, where it isn't the verdict's own


#: Which tools a route is for.
TOOLS: dict[str, Callable[[Column], Column]] = {
    "any": lambda t: F.lit(True),
    "bash": lambda t: t == "Bash",
    "shell": lambda t: t == "Shell",
    "read": lambda t: t == "Read",
    "write": lambda t: t == "Write",
    "fetch": lambda t: t == "WebFetch",
    "server": of_server,
    "mcp": lambda t: t.startswith("mcp__"),
    "agent": lambda t: t.isin("Agent", "Task"),
    "patch": lambda t: t.isin("Bash", "apply_patch"),
    "out": sends_out,
    "other": lambda t: ~t.isin("", "Bash", "Read"),
}


def _get(path: str) -> Column:
    return F.get_json_object("payload", path)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _raw(name: str) -> Column:
    """A top-level value of the payload as JSON, a string with its quotes; null if it's missing."""
    return F.to_json(F.try_variant_get(parse_json(F.col("payload")), f"$.{name}", "variant"))


def _written() -> Column:
    """Fields that are shaped like what a write brings: content, *_string, *_source, at the top and in edits."""
    shaped = lambda m: F.map_filter(m, lambda k, _: write_shaped(k))
    top = shaped(F.from_json(_get("$.tool_input"), "map<string,string>"))
    edits = F.transform(F.from_json(_get("$.tool_input.edits"), "array<map<string,string>>"), shaped)
    return _json(top=F.coalesce(top, F.create_map().cast("map<string,string>")), edits=edits)


#: JSON text that is scanned.
PARTS: dict[str, Callable[[], Column]] = {
    "command": lambda: _json(command=_get("$.tool_input.command")),
    "content": lambda: _json(content=_get("$.tool_input.content")),
    "file": lambda: _json(file_text=F.col("file_text")),
    "written": _written,
    "fetch": lambda: _json(prompt=_get("$.tool_input.prompt"), url=_get("$.tool_input.url")),
    "input": lambda: _raw("tool_input"),
    "response": lambda: F.coalesce(_raw("tool_response"), _get("$.tool_response")),
    "output": lambda: _raw("tool_output"),
    "prompt": lambda: _json(prompt=_get("$.prompt")),
    # a form counts only once it's accepted, and not where the value goes another way
    "form": lambda: F.when((F.coalesce(_get("$.mode"), F.lit("")) != "url") & (_get("$.action") == "accept"), _raw("content")),
    "payload": lambda: _raw("payload"),
    "tool_call": lambda: _raw("input"),
    "args": lambda: _raw("args"),
    "result": lambda: F.to_json(F.map_filter(F.from_json("payload", "map<string,variant>"), lambda k, _: k.isin("output", "metadata"))),
    "nothing": lambda: F.lit(None).cast("string"),
}



def _flat_leaves() -> Column:
    return F.map_values(F.from_json("_part", "map<string,string>"))


def _written_leaves() -> Column:
    every = lambda s: F.concat(F.array(s["top"]), F.coalesce(s["edits"], F.array().cast("array<map<string,string>>")))
    return let(F.from_json("_part", "struct<top: map<string,string>, edits: array<map<string,string>>>"), lambda s: F.flatten(F.transform(every(s), lambda m: F.coalesce(F.map_values(m), F.array().cast("array<string>")))))


#: Strings of the parts whose shape is known.
LEAVES: dict[str, Callable[[], Column]] = {"command": _flat_leaves, "content": _flat_leaves, "file": _flat_leaves, "fetch": _flat_leaves, "prompt": _flat_leaves, "written": _written_leaves}

#: The first that fits an event is its route.
ROUTES = (
    Route("claudecode", "pre_tool", "bash", "command", "a", "wrap", "command"),
    Route("claudecode", "pre_tool", "read", "file", "", "rewrite", "file_path"),
    Route("claudecode", "pre_tool", "fetch", "fetch", "a", "deny", may_warn=True),
    Route("claudecode", "pre_tool", "mcp", "input", "a", "deny", may_warn=True),
    Route("claudecode", "pre_tool", "agent", "nothing", "a", "prime", "prompt"),
    Route("claudecode", "pre_tool", "any", "written", "a", "deny", may_warn=True),
    Route("claudecode", "post_tool", "other", "response", "", "rewrite"),
    Route("claudecode", "prompt", "any", "prompt", "a", "deny", "prompt"),
    Route("claudecode", "session_start", "any", "nothing", "a", "prime"),
    Route("claudecode", "session_end", "any", "nothing", "a", "pass"),
    Route("claudecode", "pre_compact", "any", "file", "", "warn", "transcript", log="transcript-scan"),
    Route("claudecode", "post_compact", "any", "file", "", "warn", "transcript", log="post-summary-scan"),
    Route("claudecode", "elicitation", "any", "nothing", "a", "observe"),
    Route("claudecode", "elicitation_result", "any", "form", "af", "warn", "*", log="form-credential-detected"),
    Route("codex", "pre_tool", "patch", "command", "a", "deny", "command"),
    Route("codex", "pre_tool", "mcp", "input", "a", "deny"),
    Route("codex", "post_tool", "any", "response", "", "deny", "*"),
    Route("codex", "prompt", "any", "prompt", "a", "deny", "prompt"),
    Route("codex", "session_start", "any", "nothing", "a", "prime"),
    Route("cursor", "pre_tool", "shell", "command", "a", "deny", "command"),
    Route("cursor", "pre_tool", "read", "file", "", "rewrite", "file_path", log="redirected"),
    Route("cursor", "pre_tool", "write", "content", "a", "deny", "content"),
    Route("cursor", "pre_tool", "server", "input", "a", "deny"),
    Route("cursor", "post_tool", "any", "output", "uj", "rewrite"),
    Route("cursor", "prompt", "any", "prompt", "a", "deny", "prompt"),
    Route("cursor", "session_start", "any", "nothing", "a", "prime"),
    Route("pi", "provider_request", "any", "payload", "", "rewrite"),
    Route("pi", "tool_call", "mcp", "tool_call", "a", "deny", "*"),
    Route("pi", "agent_start", "any", "nothing", "a", "prime"),
    Route("opencode", "before", "out", "args", "a", "deny", "*"),
    Route("opencode", "after", "any", "result", "s", "rewrite"),
    Route("aider", "preflight", "any", "file", "a", "warn", "file_path"),
)


def _changed(field: str, value: Column) -> Column:
    """The tool's input with one of its fields put anew, as JSON."""
    of = F.from_json(_get("$.tool_input"), "map<string,variant>")
    return F.to_json(F.map_concat(F.map_filter(of, lambda k, _: k != field), F.create_map(F.lit(field), value.cast("variant"))))


def copy_path(folder: str, path: Column, text: Column) -> Column:
    """Where a redacted copy goes: a folder of its own for each path and text, under the file's own name."""
    return F.concat(F.lit(f"{folder.rstrip('/')}/"), F.left(F.sha2(F.concat_ws("\n", path, text), 256), F.lit(32)), F.lit("/"), F.regexp_extract(path, r"([^/\\]*)\z", 1))


def decide(events: DataFrame, rules: Sequence[Rule], settings: Settings = Settings(), routes: Sequence[Route] = ROUTES, only_actions: bool = False) -> DataFrame:
    """events with action, rules, fields, field, reason, updated (JSON that's to be put in place), copy and copy_text (of a file that was read) and log (the audit log's word; null if nothing is logged).

    events: harness, event, tool, payload (JSON text), and file_text where a file or transcript that the event names has
    been joined. An event without a route passes; so does everything while paused, but that prompts and sessions get a
    banner and that forms are still observed in the log. Actions: pass, deny, warn, rewrite, wrap, prime, notice, observe.
    only_actions: events with action alone. Texts in which expressions can tell that there's a finding then don't pass the engine.
    """
    given = events.columns
    if "file_text" not in events.columns:
        events = events.withColumn("file_text", F.lit(None).cast("string"))
    tool = F.coalesce(F.col("tool"), F.lit(""))
    route = F.lit(-1)
    for k, r in reversed(list(enumerate(routes))):
        route = F.when((F.col("harness") == r.harness) & (F.col("event") == r.event) & TOOLS[r.when](tool), k).otherwise(route)
    # a time that can't be read pauses
    paused = F.coalesce(F.try_to_timestamp(F.lit(settings.paused_until)) > F.current_timestamp(), F.lit(True)) if settings.paused_until is not None else F.lit(False)
    if not settings.scan_output:
        route = F.when((F.col("harness") == "claudecode") & (F.col("event") == "post_tool"), -1).otherwise(route)
    path = F.coalesce(_get("$.tool_input.file_path"), _get("$.tool_input.notebook_path"))
    df = events.withColumn("_route", route).withColumn("_paused", paused)

    def chosen(pick) -> Column:
        """What the route of a row says, null without one."""
        by: dict = {}
        for k, r in enumerate(routes):
            by.setdefault(pick(r), []).append(k)
        out = F.lit(None)
        for value, ks in by.items():
            out = F.when(F.col("_route").isin(*ks), value() if callable(value) else F.lit(value)).otherwise(out)
        return out

    by_path = [k for k, r in enumerate(routes) if r.part in ("file", "written", "content") and r.event == "pre_tool"]
    passed_over = F.col("_route").isin(*by_path) & skipped(path, (*SKIP, *settings.skip))
    df = df.withColumn("_part", F.when(~F.col("_paused") & ~passed_over, chosen(lambda r: PARTS[r.part]).cast("string")))
    walked = worth_walking(rules, F.col("_part"))
    if only_actions:
        leaves = chosen(lambda r: LEAVES.get(r.part)).cast("array<string>")
        sure = F.exists(leaves, lambda s: F.coalesce((F.octet_length(s) <= LONG_BYTES) & surely_redacted(rules, s), F.lit(False))) & F.is_valid_utf8("_part")
        df = df.withColumn("_sure", F.coalesce(sure, F.lit(False)))
        walked = ~F.col("_sure") & walked
    df = df.withColumn("_f", tree_udf(rules)(F.when(walked, F.col("_part")), chosen(lambda r: r.mode).cast("string")))
    hit = F.coalesce(F.size("_f.rules"), F.lit(0)) > 0
    if only_actions:
        hit = F.col("_sure") | hit
    verdict = F.when(~F.col("_paused"), chosen(lambda r: r.verdict)).otherwise(F.lit(None))
    verdict = F.coalesce(verdict, F.lit("pass"))
    allowed = (F.col("event") == "post_tool") & (F.col("harness") == "claudecode") & tool_matches(tool, settings.allow_tools)
    command, prompt = F.coalesce(_get("$.tool_input.command"), F.lit("")), F.coalesce(_get("$.tool_input.prompt"), F.lit(""))
    told = (F.col("event") == "prompt") & (F.coalesce(_get("$.prompt"), F.lit("")) != "") & F.col("_route").isin(*range(len(routes)))
    action = (
        F.when(F.col("_paused") & told, "notice")
        .when(F.col("_paused") & (F.col("event") == "session_start") & (F.col("_route") >= 0), "prime")
        .when(verdict.isin("pass", "observe"), verdict)
        .when(verdict == "prime", F.when((F.col("event") == "pre_tool") & ((prompt == "") | prompt.contains(PRIMING_MARK)), "pass").otherwise("prime"))
        .when((verdict == "wrap") & hit, "deny")
        .when(verdict == "wrap", F.when((command == "") | already_wrapped(settings.runner, command), "pass").otherwise("wrap"))
        .when(~hit, "pass")
        .when(allowed, "warn")
        .when((verdict == "deny") & F.coalesce(chosen(lambda r: r.may_warn), F.lit(False)) & F.lit(settings.warn_only), "warn")
        .otherwise(verdict)
    )
    if only_actions:
        return df.withColumn("action", action).select(*[c for c in given if c != "action"], "action")
    df = df.withColumn("action", action).withColumn("fields", F.coalesce(F.transform("_f.fields", lambda x: F.regexp_replace(x, r"\Atop\.", "")), F.array().cast("array<string>")))
    named = F.coalesce(chosen(lambda r: r.field).cast("string"), F.lit(""))
    field = F.when(named == "*", F.array_join("fields", ",")).when(named == "", F.regexp_replace(F.coalesce(F.col("_f.path"), F.lit("")), r"\Atop\.", "")).otherwise(named)
    # what's told of a first hit are that one's rules
    first = (named == "") & chosen(lambda r: r.verdict).isin("deny", "rewrite") & F.col("event").isin("pre_tool", "post_tool") & ~F.coalesce(chosen(lambda r: r.mode) == "uj", F.lit(False))
    ids = F.coalesce(F.when(F.coalesce(first, F.lit(False)), F.col("_f.first")).otherwise(F.col("_f.rules")), F.array().cast("array<string>"))
    df = df.withColumn("rules", ids).withColumn("field", F.when(hit, field).otherwise(F.lit("")))
    what = F.when(tool == "", F.col("event")).otherwise(tool)
    reason = F.when(F.col("action").isin("deny", "warn", "rewrite") & hit, F.concat(F.lit("field "), F.col("field"), F.lit(" of "), what, F.lit(" contains an apparent "), F.array_join("rules", ", ")))
    reason = F.when(F.col("action") == "notice", F.lit(BANNER)).otherwise(F.coalesce(reason, F.lit("")))
    stream = F.coalesce(_get("$.tool_input.run_in_background") == "true", F.lit(False))
    is_file = (F.col("action") == "rewrite") & F.col("_route").isin(*[k for k, r in enumerate(routes) if r.part == "file"])
    df = df.withColumn("copy_text", F.when(is_file, F.get_json_object("_f.text", "$.file_text")))
    df = df.withColumn("copy", F.when(is_file, copy_path(settings.copies, path, F.col("copy_text"))))
    primed = F.concat(F.when(F.col("_paused"), F.lit(f"{BANNER}\n\n")).otherwise(F.lit("")), F.lit(PRIMING))
    updated = (
        F.when(is_file, _changed("file_path", F.col("copy")))
        .when(F.col("action") == "rewrite", F.col("_f.text"))
        .when(F.col("action") == "wrap", _changed("command", wrap_command(settings.runner, command, stream)))
        .when((F.col("action") == "prime") & (F.col("event") == "pre_tool"), _changed("prompt", F.concat(F.lit(f"{PRIMING}\n\n---\n\n"), prompt)))
        .when((F.col("action") == "prime") & (F.col("event") == "agent_start"), _json(systemPrompt=F.concat(F.coalesce(_get("$.systemPrompt"), F.lit("")), F.lit("\n\n"), primed)))
        .when(F.col("action") == "prime", _json(context=primed))
    )
    words = F.create_map(*[F.lit(x) for kv in (("deny", "blocked"), ("rewrite", "redacted"), ("wrap", "wrapped"), ("warn", "warned"), ("observe", "observed")) for x in kv])
    log = (
        F.when(chosen(lambda r: r.verdict) == "observe", "observed")
        .when((F.col("action") == "warn") & allowed, "warned-suppressed")
        .when((F.col("action") == "warn") & (chosen(lambda r: r.verdict) == "deny"), "blocked-downgraded")
        .when((F.col("action") == "prime") & (F.col("event") == "pre_tool"), "primed")
        .when(hit, F.coalesce(F.nullif(chosen(lambda r: r.log).cast("string"), F.lit("")), F.try_element_at(words, F.col("action"))))
        .when(F.col("event").isin("pre_compact", "post_compact") & F.col("file_text").isNotNull() & ~F.col("_paused") & (F.col("_route") >= 0), "clean")
        .otherwise(F.try_element_at(words, F.col("action")))
    )
    server = F.coalesce(_get("$.mcp_server_name"), F.lit(""))
    mode = F.coalesce(F.nullif(_get("$.mode"), F.lit("")), F.lit(""))
    place = (
        F.when(F.col("event") == "elicitation", F.concat(server, F.when(mode != "", F.concat(F.lit("("), mode, F.lit(")"))).otherwise(F.lit(""))))
        .when(F.col("event") == "elicitation_result", F.concat(server, F.lit(":"), F.col("field")))
        .when(F.col("harness").isin("pi", "opencode") & (F.col("action") == "deny"), F.concat(tool, F.lit(":"), F.col("field")))
        .otherwise(F.col("field"))
    )
    df = df.withColumn("reason", reason).withColumn("updated", updated).withColumn("log", log).withColumn("log_field", F.when(F.col("log").isNotNull(), place))
    return df.drop("_route", "_paused", "_part", "_f")


def decision_json(harness: Column, event: Column, action: Column, reason: Column, updated: Column) -> Column:
    """The decision in the shape that the harness expects; {} where it changes nothing."""
    put = parse_json(F.coalesce(updated, F.lit("null")))
    context = F.get_json_object(updated, "$.context")
    pre = F.lit("PreToolUse").alias("hookEventName")
    own = lambda *fields: F.to_json(F.struct(F.struct(*fields).alias("hookSpecificOutput")))
    like_claude = harness.isin("claudecode", "codex")
    told = lambda name, text: own(F.lit(name).alias("hookEventName"), text.alias("additionalContext"))
    return F.coalesce(
        F.when(
            like_claude,
            F.when((event == "pre_tool") & (action == "deny"), own(pre, F.lit("deny").alias("permissionDecision"), reason.alias("permissionDecisionReason")))
            .when((event == "pre_tool") & (action == "warn"), own(pre, F.lit("allow").alias("permissionDecision"), F.concat(F.lit("would have been blocked: "), reason).alias("permissionDecisionReason")))
            .when((event == "pre_tool") & action.isin("rewrite", "wrap", "prime"), own(pre, put.alias("updatedInput")))
            .when((event == "post_tool") & (action == "rewrite"), own(F.lit("PostToolUse").alias("hookEventName"), reason.alias("additionalContext"), put.alias("updatedToolOutput")))
            .when(action == "deny", _json(decision=F.lit("block"), reason=reason))
            .when(action == "notice", told("UserPromptSubmit", reason))
            .when(action == "prime", told("SessionStart", context))
            .when((action == "warn") & (event != "post_tool"), _json(systemMessage=reason)),
        )
        .when(
            harness == "cursor",
            F.when((event == "prompt") & action.isin("deny", "notice"), _json(**{"continue": action == "notice"}, user_message=reason))
            .when(action == "deny", _json(permission=F.lit("deny"), user_message=reason))
            .when((event == "pre_tool") & (action == "rewrite"), _json(permission=F.lit("allow"), user_message=reason, updated_input=put))
            .when(action == "rewrite", _json(updated_mcp_tool_output=put))
            .when(action == "prime", _json(additional_context=context)),
        )
        .when(harness.isin("pi", "opencode") & (action == "deny"), _json(block=F.lit(True), reason=reason))
        .when((harness == "pi") & (action == "rewrite"), _json(payload=put))
        .when(harness.isin("pi", "opencode") & action.isin("rewrite", "prime"), updated)
        .when((harness == "aider") & (action == "warn"), _json(warning=reason)),
        F.lit("{}"),
    )


def audit_entries(decided: DataFrame, ts: str) -> DataFrame:
    """Entries for the audit log of events that led to anything: ts, tool, action, rules, count, field."""
    tool = F.coalesce(F.nullif(F.col("tool"), F.lit("")), F.col("event"))
    named = F.when(F.col("harness") == "claudecode", tool).otherwise(F.concat("harness", F.lit("/"), tool))
    when = F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return decided.where(F.col("log").isNotNull()).select(when.alias("ts"), named.alias("tool"), F.col("log").alias("action"), "rules", F.size("rules").alias("count"), F.col("log_field").alias("field"))


__all__ = ["BANNER", "PRIMING", "ROUTES", "Route", "Settings", "audit_entries", "copy_path", "decide", "decision_json", "replace"]
