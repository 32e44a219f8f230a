"""Redaction semantics: rules, splicing, views, decoding, markers, trees, catalog, audit, policy, globs, shell words."""

import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.catalog import BadRule, Rule
from veilspark.engine import Engine, Finding, decodings, leaks, placeholder, views
from veilspark.functions import paths, text
from veilspark.operators import audit, detect, policy, tree
from veilspark.operators.redact import redact, redact_surface
from veilspark.plans.queries import CORE, RULES

KEY = "AKIA" + "QYLPMN5HGZRTWXKB"
PAT = "ghp_" + "0123456789abcdefghijABCDEFGHIJ012345"
BEARER = "Authorization: " + "Bearer " + "k3J9xQ2mV8bT5nR7wZ1cL6pD4"
AWS, PATR = RULES["aws-access-key"], RULES["github-pat-classic"]


def one(spark, values, fn, column="s string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, {column}")
    return [r["out"] for r in df.select("k", fn(F.col("s")).alias("out")).orderBy("k").collect()]


# Catalog ------------------------------------------------------------------------------


def test_builtin_packs():
    assert len(catalog.builtin("core")) == 19 and len(catalog.builtin("pii")) == 12
    assert sum(bool(r.filter) for r in catalog.builtin("core")) == 8


def test_layers_and_provenance():
    c = catalog.compose({"embedded": [Rule("a", "x"), Rule("b", "y")], "user": [Rule("b", "z")], "env": [Rule("c", "w")]}, {"a"})
    assert [r.id for r in c.rules] == ["b", "c"]
    b = next(r for r in c.listed if r.id == "b")
    assert (b.source, b.overridden_from, b.overridden) == ("user", "embedded", True)
    assert [(r.source, r.id, r.disabled) for r in c.listed] == [("embedded", "a", True), ("user", "b", False), ("env", "c", False)]


def test_load_from_folders(tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "1.toml").write_text('[[rules]]\nid = "mine"\nregex = "(m[0-9]{4})"\nkeywords = ["M"]\n')
    (tmp_path / "u" / "2.toml").write_text("not toml at all [")
    deep = tmp_path / "p" / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "p" / catalog.CONFIG_NAME).write_text('[[rules]]\nid = "gitlab-pat"\nregex = "(glpat-x)"\n[[rules]]\nid = "bad"\nregex = "a{2000}"\n')
    c = catalog.load(str(tmp_path / "u"), str(deep), disabled={"slack-token"})
    assert len(c.warnings) == 2 and any(r.id == "mine" and r.keywords == ("m",) for r in c.rules)
    assert catalog.project_warning(c, ("x/**",)) == (["gitlab-pat"], 2)
    assert "slack-token" not in [r.id for r in c.rules] and "bad" not in [r.id for r in c.listed]


@pytest.mark.parametrize("regex", ["a{1001}", "(?=x)", r"(a)\1", "(a+)+b", "[", ""])
def test_bad_rules(regex):
    with pytest.raises(BadRule):
        catalog.check(Rule("r", regex))


def test_filters():
    terms = catalog.parse_filter('entropy(finding["secret"]) <= 3.5 || matchesAny(finding["secret"], ["^a$", "b\\\\."])')
    assert [(t.kind, t.limit, t.values) for t in terms] == [("entropy", 3.5, ()), ("any", 0.0, ("^a$", "b\\."))]
    with pytest.raises(ValueError):
        catalog.parse_filter("failsTokenEfficiency(x)")


def test_dialect(spark):
    cases = [(r"a$", "a\n", False), (r"a$", "a", True), (r"^\s$", "\x0b", False), (r"^\s$", "\t", True), (r"\bk", "ék", True), (r"(?m)^b$", "a\nb\nc", True), (r"[&&x]", "&", True), (r"(?i)k", "K", True)]
    for rx, s, want in cases:
        got = spark.createDataFrame([(s,)], "s string").select(F.col("s").rlike(catalog.to_java(rx)).alias("m")).first()["m"]
        assert got is want, (rx, s)


# Rules ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "rule, hit, content",
    [
        ("redis-auth-command", True, "AUTH " + "S3cr3tPassw0rdLong99"),
        ("redis-auth-command", True, "log\nAUTH user " + "Z3cr3tPassw0rdLong99 "),
        ("redis-auth-command", False, "AUTH lowercaseonlywordshere"),
        ("redis-auth-command", False, "AUTH ${REDIS_PASSWORD_LONG}"),
        ("redis-auth-array", True, '["AUTH", "svc", "' + 'pa55word-x"]'),
        ("redis-auth-array", False, '["AUTH", "process.env.PASSWORD"]'),
        ("redis-auth-resp", True, "*2\\r\\n$4\\r\\nAUTH\\r\\n$8\\r\\n" + "pa55word\\r\\n"),
        ("redis-auth-resp", False, "costs $4 auth $8 fee"),
        ("redis-auth-cli", True, "redis-cli -h x --pass " + "pa55word9"),
        ("redis-auth-cli", False, "redis-cli -a short"),
        ("bearer-token", False, "Bearer YOUR_TOKEN_GOES_HERE_NOW"),
        ("url-userinfo-credential", False, "https" + "://user:password@host/x"),
        ("db-connection-uri", True, "redis" + "://:hunter2x@host"),
        ("db-connection-uri", False, "postgres://localhost:5432/db"),
        ("sourcegraph-access-token", False, "sgp_ and commit " + "0123456789abcdef0123456789abcdef01234567"),
        ("pii-crypto-seed-phrase", False, "zebra " * 11 + "with"),
        ("pii-btc-p2pkh", False, "well-known 1" + "BoatSLRHtKNngkdXEeobR76b53LETtpyT"),
    ],
)
def test_rule_gates(spark, rule, hit, content):
    r = RULES[rule]
    assert bool(Engine([r]).surface(content)) is hit
    df = redact_surface(spark.createDataFrame([(content,)], "s string"), "s", [r])
    assert (len(df.first()["rules"]) > 0) is hit


def test_wrapped_text_survives(spark):
    rows = [f"before-mark {x} after-mark" for x in (KEY, PAT, BEARER)]
    for out in spark.createDataFrame([(r,) for r in rows], "s string").transform(lambda d: redact_surface(d, "s", CORE)).collect():
        assert out["redacted"].startswith("before-mark ") and out["redacted"].endswith(" after-mark") and out["rules"]


# Redaction -----------------------------------------------------------------------------------


def test_placeholder():
    assert placeholder(Finding("My Rule", "m", "x" * 11)) == "<REDACTED:my-rule>"
    assert placeholder(Finding("", "", "x" * 8 + "tail")) == "<REDACTED:secret:tail>"


def test_invariant(spark):
    """Whatever the shape, an id is attested only if no raw or encoded form of its secret is left."""
    import base64

    rng = random.Random(5)
    rows = []
    for secret, shape in itertools.product((KEY, PAT), ("plain", "ansi", "base64", "hex", "percent", "zero", "entity", "dashes")):
        enc = {
            "plain": secret, "ansi": "\x1b[31m" + secret[:9] + "\x1b[0m" + secret[9:], "base64": base64.b64encode(b"is " + secret.encode()).decode(), "hex": secret.encode().hex(),
            "percent": "".join(f"%{b:02X}" for b in secret.encode()), "zero": "​".join(secret), "entity": "".join(f"&#{ord(c)};" for c in secret), "dashes": "-".join(f"{b:02x}" for b in secret.encode()),
        }[shape]
        pad = "".join(rng.choice("xyz \n") for _ in range(rng.randrange(1, 12)))
        rows.append((secret, enc, f"top {pad} {enc} end\nlast"))
    df = redact(spark.createDataFrame(rows, "secret string, enc string, s string"), "s", [AWS, PATR])
    for r in df.collect():
        assert r["rules"] and r["enc"] not in r["redacted"] and not leaks(r["redacted"], [r["secret"]]), r
        assert r["redacted"].endswith("\nlast")


def test_benign_text_stays(spark):
    rows = ["550e8400-e29b-41d4-a716-446655440000", "de:ad:be:ef:00:11", "&lt;div&gt; &amp; more", "plain prose", "", None, "sha256:" + "ab" * 32, "<REDACTED:aws-access-key:XXXX>"]
    for r in redact(spark.createDataFrame([(x,) for x in rows], "s string"), "s", CORE).collect():
        assert r["redacted"] == r["s"] and r["rules"] == []


def test_markers(spark):
    cases = [(f"{KEY} # gitleaks:allow", True), (f"{KEY}{' ' * 130}gitleaks:allow", False), (f"{KEY}\ngitleaks:allow", False), (f"veilspark:fixture {KEY}", True)]
    for authored in (True, False):
        got = redact_surface(spark.createDataFrame(cases, "s string, near boolean"), "s", [AWS], authored).collect()
        assert [not r["rules"] for r in got] == [r["near"] and authored for r in got]
        for s, near in cases:
            assert (not Engine([AWS]).redact(s, authored)[1]) is (near and authored)


def test_native_and_engine_agree(spark):
    rng = random.Random(9)
    parts = [KEY, PAT, BEARER, "\x1b[1m", "\n", " text ", "gitleaks:allow", "é你", "password", KEY[:10]]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(200)]
    got = redact_surface(spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, s string"), "s", CORE).orderBy("k").collect()
    for r, s in zip(got, rows):
        e = Engine(CORE)
        found = list(dict.fromkeys(e.surface(s_bare := s.replace("\x1b[1m", ""))))
        out = e.splice(s, found)
        assert r["redacted"] == out, (s, s_bare)


def test_decoding():
    import base64

    once = base64.b64encode(KEY.encode()).decode()
    assert (once, KEY) in decodings(f"x {once} y")
    twice = base64.b64encode(("v=" + once).encode()).decode()
    out, ids = Engine([AWS]).redact(f"a {twice} b")
    assert ids == ["aws-access-key"] and out == f"a <REDACTED:aws-access-key:{KEY[-4:]}> b"


def test_views():
    assert views("plain") == [] and views("a​b") == ["ab"] and views("41-42-43-44") == ["41424344"] and views("&#65;") == ["A"]


# Scalars ----------------------------------------------------------------------------------------


def test_shell_words(spark):
    words = ["", "plain", "it's", "a b", "$x", "`y`", "''", "new\nline", 'q"', "back\\slash"]
    quoted = one(spark, words, text.shell_quote)
    import shlex

    assert [shlex.split(q) for q in quoted] == [[w] for w in words]
    assert one(spark, quoted, text.shell_unquote) == words
    assert one(spark, ["'a' b", "'a", "a b", ""], text.shell_unquote) == [None] * 4


def test_globs(spark):
    cases = [("**/tests/**", "a/tests/b", True), ("**/tests/**", "tests/b", True), ("**/tests/**", "mytests/b", False), ("*_test.*", "x/y_test.go", True), ("*.golden", "a.golden/b", False), ("**/a.txt", "x/y/a.txt", True), ("vendor/**", "x/vendor/y", True), ("src/*.go", "src/a.go", True), ("src/*.go", "src/b/a.go", False)]
    for glob, path, want in cases:
        assert one(spark, [path], lambda c, g=glob: paths.skipped(c, (g,))) == [want], (glob, path)
    assert one(spark, ["", None], lambda c: paths.skipped(c)) == [False, False]


def test_entities(spark):
    assert one(spark, ["&#65;&#x42;", "&amp;lt;", "&nope; &lt;", "&#0;&#128;&#99999999999;", "none"], text.decode_entities) == ["AB", "&lt;", "&nope; <", "�€�", "none"]


# Trees ---------------------------------------------------------------------------------------------


def test_tree_paths_and_depth(spark):
    e = Engine([AWS, PATR])
    node = {"b": [1, None, {"c": KEY}], "a": {"x": "clean", KEY: "v"}, "d": PAT}
    assert e.first_hit(node) == ("b[2].c", ["aws-access-key"])
    assert e.all_hits(node) == (["aws-access-key", "github-pat-classic"], ["b[2].c", "d"])
    assert e.all_hits(KEY) == (["aws-access-key"], ["(root)"])
    new, ids = e.redact_tree(node)
    assert KEY in new["a"] and new["b"][:2] == [1, None] and KEY not in json.dumps(new["b"]) and len(ids) == 2
    for depth, fires in ((10, True), (114, False)):
        deep = KEY
        for _ in range(depth):
            deep = {"k": deep}
        assert bool(e.all_hits(deep)[0]) is fires and (e.redact_tree(deep)[0] != deep) is fires


def test_tree_columns(spark):
    rows = [(1, json.dumps({"a": [KEY], "b": "x"})), (2, "not json " + KEY), (3, "{}"), (4, None), (5, json.dumps(json.dumps({"q": KEY})))]
    df = spark.createDataFrame(rows, "k int, j string")
    hits = {r["k"]: r["fields"] for r in tree.all_hits(df, "k", "j", [AWS]).collect()}
    assert hits == {1: ["a[0]"], 2: ["(root)"], 5: ["(root)"]}
    out = {r["k"]: r for r in tree.redact_json(df, "j", [AWS], unwrap=True).collect()}
    assert out[1]["path"] == "a[0]" and out[3]["redacted"] == "{}" and out[4]["redacted"] is None and KEY not in out[2]["redacted"] and out[5]["path"] == "q"


# Audit -----------------------------------------------------------------------------------------------


def test_chain_and_verify(spark):
    rows = [("l", k, f"2026-01-01T00:00:0{k}Z", "Bash", "blocked", ["a<b>&c"], 1, "x\x1b\x7f ") for k in range(6)]
    df = spark.createDataFrame(rows, "log string, n int, ts string, tool string, action string, rules array<string>, count int, field string")
    lines = audit.chain(df, "log", "n")
    got = [r["line"] for r in lines.orderBy("line_no").collect()]
    prev = ""
    for line in got:
        e = json.loads(line)
        assert e["prev"] == prev and "\\u003c" in line and "\\u2028" in line and "\\u001b" in line
        prev = e["hash"]
        assert hashlib.sha256(line.replace(e["hash"], "").encode()).hexdigest() == e["hash"]
    assert {r["kind"] for r in audit.verify(lines).collect()} == {"ok"}
    bad = list(got)
    bad[1] = bad[1].replace("blocked", "allowed")
    del bad[3]
    bad += ["", '{"ts":"t","tool":"x","action":"y"}', "{"]
    df2 = spark.createDataFrame([("l", k + 1, b) for k, b in enumerate(bad)], "log string, line_no long, line string")
    assert [r["kind"] for r in audit.verify(df2).orderBy("line_no").collect()] == ["ok", "hash", "ok", "chain", "ok", "legacy", "parse"]
    s = audit.summary(audit.verify(df2)).first()
    assert (s["total"], s["verified"], s["legacy"], s["broken"], s["ok"]) == (7, 3, 1, 3, False)
    more = audit.append(lines, df.withColumn("n", F.col("n") + 10), "log", "n")
    assert {r["kind"] for r in audit.verify(more).collect()} == {"ok"} and more.count() == 12


# Policy ------------------------------------------------------------------------------------------------


def decide(spark, rows, **settings):
    df = spark.createDataFrame(rows, "harness string, event string, tool string, payload string, file_text string")
    return [(r["action"], r["field"]) for r in policy.decide(df, [AWS, PATR], policy.Settings(**settings)).collect()]


def test_policy(spark):
    j = json.dumps
    rows = [
        ("claudecode", "pre_tool", "Read", j({"tool_input": {"file_path": "a.env"}}), f"k={KEY}"),
        ("claudecode", "pre_tool", "Read", j({"tool_input": {"file_path": "x/tests/a.env"}}), f"k={KEY}"),
        ("claudecode", "pre_tool", "MultiEdit", j({"tool_input": {"edits": [{"new_string": KEY, "old": KEY}]}}), None),
        ("claudecode", "pre_tool", "Edit", j({"tool_input": {"other": KEY}}), None),
        ("claudecode", "pre_tool", "Bash", j({"tool_input": {"command": "veilspark run -- bash -c x"}}), None),
        ("codex", "post_tool", "any", j({"tool_response": {"o": [KEY]}}), None),
        ("codex", "pre_tool", "apply_patch", j({"tool_input": {"command": f"+{PAT}"}}), None),
        ("cursor", "post_tool", "x", j({"tool_output": j({"a": KEY})}), None),
        ("pi", "tool_call", "mcp__a", j({"input": {"z": KEY}}), None),
        ("pi", "tool_call", "local", j({"input": {"z": KEY}}), None),
        ("opencode", "before", "srv_tool", j({"args": {"q": KEY}}), None),
        ("opencode", "before", "apply_patch", j({"args": {"q": KEY}}), None),
        ("opencode", "after", "bash", j({"output": f"k {KEY}", "metadata": {"m": 1}}), None),
        ("claudecode", "elicitation", "", "{}", None),
        ("unknown", "x", "", j({"prompt": KEY}), None),
    ]
    assert [a for a, _ in decide(spark, rows)] == ["rewrite", "pass", "deny", "pass", "pass", "deny", "deny", "rewrite", "deny", "pass", "deny", "pass", "rewrite", "observe", "pass"]
    assert {a for a, _ in decide(spark, rows, paused_until="2999-01-01T00:00:00Z")} == {"pass"}
    warn = [a for a, _ in decide(spark, rows, warn_only=True)]
    assert warn[2] == "warn" and warn[5] == "deny"
    post = [("claudecode", "post_tool", "mcp__ok__get", j({"tool_response": KEY}), None)]
    assert decide(spark, post, allow_tools=("mcp__ok__*",))[0][0] == "warn" and decide(spark, post)[0][0] == "rewrite"


# Streams and sources ----------------------------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    from veilspark.sources import text as sources
    from veilspark.streaming.lines import lines, redact_lines, run

    body = [f"line {KEY}", "clean", f"x {PAT} y gitleaks:allow", ""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(body) + "\n")
    seen = []
    q = run(redact_lines(lines(spark, str(tmp_path / "in")), [AWS, PATR]), lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state"), lambda ids, _: seen.append(ids))
    q.awaitTermination()
    batch = redact(spark.read.text(str(tmp_path / "in")), "value", [AWS, PATR])
    key = lambda rows: sorted((r["redacted"], tuple(r["rules"])) for r in rows)
    assert key(spark.read.parquet(str(tmp_path / "out")).collect()) == key(batch.collect())
    assert seen == [["aws-access-key", "github-pat-classic"]]
    log = sources.log_lines(spark, str(tmp_path / "in")).orderBy("line_no").collect()
    assert [r["line"] for r in log] == body
    (tmp_path / ".git").mkdir()
    (tmp_path / ".env").write_text("A=1")
    (tmp_path / "in" / ".env").write_text("B=1")
    assert len(sources.dotenv_files(str(tmp_path / "in"))) == 2


def test_queries_have_oracles(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_classes_dots_and_flags():
    from veilspark.catalog import BadRule, check, to_java

    assert to_java(r"a.[[:alpha:]]$") == r"a[^\n][A-Za-z]\z"
    assert to_java("(?s)a.(?-s:.)") == r"a[\x00-\x{10FFFF}](?:[^\n])"
    for bad in (r"\pL", r"(?U)a+", r"\Qa\E", "[[:nope:]]", "a(?i)b|c"):
        with pytest.raises(BadRule):
            check(Rule("x", bad))


def test_malformed_pause_and_forms(spark):
    j = json.dumps
    form = lambda **x: ("claudecode", "elicitation_result", "", j({"action": "accept", "mode": "form", "content": {"b": KEY, "a": KEY, "n": {"x": KEY}}} | x), None)
    assert decide(spark, [form()]) == [("warn", "a,b")]
    assert [a for a, _ in decide(spark, [form(mode="url"), form(action="decline"), form(content=None)])] == ["pass"] * 3
    assert decide(spark, [form()], paused_until="soon") == [("pass", "")]


def test_rows_with_equal_keys_stay_apart(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": KEY})), (1, json.dumps({"b": KEY}))], "k int, j string")
    assert sorted(r["fields"] for r in tree.all_hits(df, "k", "j", [AWS]).collect()) == [["a"], ["b"]]
    assert sorted(r["field"] for r in tree.first_hit(df, "k", "j", [AWS]).collect()) == ["a", "b"]


def test_audit_entries_and_writer(spark, tmp_path):
    from veilspark.streaming.lines import audit_writer

    rows = [("claudecode", "pre_tool", "Bash", json.dumps({"tool_input": {"command": KEY}}), None), ("pi", "tool_call", "mcp__a", json.dumps({"input": {"z": KEY}}), None), ("claudecode", "elicitation", "", "{}", None), ("claudecode", "pre_compact", "", "{}", "clean")]
    df = spark.createDataFrame(rows, "harness string, event string, tool string, payload string, file_text string")
    entries = policy.audit_entries(policy.decide(df, [AWS]).withColumn("ts", F.lit("2026-01-01 00:00:00")), "ts")
    got = {r["tool"]: (r["action"], r["count"], r["field"]) for r in entries.collect()}
    assert got == {"Bash": ("blocked", 1, "command"), "pi/mcp__a": ("blocked", 1, "mcp__a:z"), "elicitation": ("observed", 0, ""), "pre_compact": ("clean", 0, "")}
    write = audit_writer(spark, str(tmp_path / "log"), "log", "n")
    for batch in (0, 1, 1, 2):  # a batch that's repeated changes nothing
        write(entries.withColumn("log", F.lit("l")).withColumn("n", F.monotonically_increasing_id()), batch)
    lines = spark.read.parquet(str(tmp_path / "log" / "lines"))
    assert {r["kind"] for r in audit.verify(lines).collect()} == {"ok"} and lines.count() == 12 == lines.agg(F.max("line_no")).first()[0]


def test_all_entities(spark):
    assert one(spark, ["&hearts;&Alpha;&NotEqualTilde;&AMP;lt;"], text.decode_entities) == ["♥Α≂̸&lt;"]
