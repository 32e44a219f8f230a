"""Texts that are odd, long or broken, and repeated values: native expressions and the engine agree, and nothing leaks."""

import base64
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.catalog import BadRule, Rule
from veilspark.engine import Engine, decodings
from veilspark.operators import audit, catalogs, locate, policy, tree
from veilspark.operators.decode import decodings as native_decodings
from veilspark.operators.redact import redact, redact_surface
from veilspark.plans.queries import RULES
from veilspark.sources.text import split_failed
from veilspark.streaming.keyed import over_the_end

KEY = "AKIA" + "QYLPMN5HGZRTWXKB"
AWS, PAT, BTC = RULES["aws-access-key"], RULES["github-pat-classic"], RULES["pii-btc-p2pkh"]
URL = RULES["url-userinfo-credential"]


def b64(s: str) -> str:
    return base64.b64encode(s.encode()).decode()


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = [
        KEY, KEY, b64(f"is {KEY}!"), b64(b64(KEY + " twice")), KEY.encode().hex(), "".join(f"%{b:02x}" for b in KEY.encode()), "".join(f"\\u{ord(c):04x}" for c in KEY), " ".join(f"U+{ord(c):04X}" for c in KEY), "​".join(KEY),
        "-".join(f"{b:02x}" for b in KEY.encode()), "".join(f"&#{ord(c)};" for c in KEY), "\x1b[31m", "\n", "\n", " gitleaks:allow ", "x" * 130, "é你🙂", "%zz+%41", "abc=", "U+0041 ", "deadbeef" * 3, "&amp;", "a&lt;b", KEY[:9],
    ]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(1, 8))) for _ in range(n)]


@pytest.mark.parametrize("authored", [False, True])
def test_native_passes_equal_the_engine(spark, authored):
    rows = texts(250, 11)
    df = spark.createDataFrame(list(enumerate(rows)), "k int, s string")
    got = redact(df, "s", [AWS, PAT], authored, depth=2).orderBy("k").collect()
    engine = Engine([AWS, PAT], depth=2)
    for r, s in zip(got, rows):
        assert (r["redacted"], r["rules"]) == engine.redact(s, authored), s


def test_native_segments_equal_the_engine(spark):
    rows = [*texts(150, 12), "U+0041 U+0042 ", "U+0041U+0042", "%%41", "a%4", "QUJD" * 4 + "=", "QUJD" * 4 + "A", "ab" * 8 + "c", "", "\\u00e9" * 3]
    got = spark.createDataFrame(list(enumerate(rows)), "k int, s string").select("k", native_decodings(F.col("s")).alias("d")).orderBy("k").collect()
    for r, s in zip(got, rows):
        assert [tuple(d) for d in r["d"] if d["text"] != d["segment"]] == decodings(s), s


def test_deep_expressions_need_no_python(spark):
    df = spark.createDataFrame([("x",)], "s string")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan(redact(df, "s", [AWS], depth=2)) and "Python" in plan(redact(df, "s", [AWS]))
    assert "Python" not in plan(tree.all_hits(df.withColumn("k", F.lit(1)), "k", "s", [AWS], depth=2))


@pytest.mark.parametrize("body", [b64("x" * 750_000), "ab" * 500_000, "%41" * 300_000, "\\u0041" * 150_000, "U+0041 " * 150_000, "41-" * 300_000, "a" * 1_000_000, "%4" * 400_000])
def test_long_runs_take_linear_time(spark, body):
    text = f"{body} {b64('key is ' + KEY)}"
    began = time.time()
    out, ids = Engine([AWS]).redact(text)
    assert ids == ["aws-access-key"] and time.time() - began < 20
    r = redact(spark.createDataFrame([(text,)], "s string"), "s", [AWS], depth=2).first()
    assert (r["redacted"], r["rules"]) == (out, ids)


def test_repeated_values(spark):
    coin = "1" + "BoatSLRHtKNngkdXEeobR76b53LETtpyT"
    allowed = f"pay {coin} genesis block\npay {coin} now"
    marked = f"{KEY} # gitleaks:allow\nplain {KEY} here"
    for s, rule, authored in ((allowed, BTC, False), (marked, AWS, True)):
        df = spark.createDataFrame([(s,)], "s string")
        surface, deep = redact_surface(df, "s", [rule], authored).first(), redact(df, "s", [rule], authored).first()
        assert surface["redacted"] == deep["redacted"] == Engine([rule]).redact(s, authored)[0]
        assert coin not in surface["redacted"] and KEY not in surface["redacted"] and surface["rules"] == [rule.id]
        first = s.split("\n")[0]
        assert redact_surface(spark.createDataFrame([(first,)], "s string"), "s", [rule], authored).first()["redacted"] == first


def test_json_with_escapes_and_halves(spark):
    rows = [
        '{"u":"https:\\/\\/user:secretpw@host\\/x"}', '{"a":"\\ud800 ' + KEY + '"}', '{"\\udc00":["' + KEY + '"],"n":1e400,"m":100.0}', '{"a":"' + KEY + '","a":{"b":"' + KEY + '"}}', '  [ "AK\\u0049A' + KEY[4:] + '" , 12345678901234567890123 ]', '"' + KEY + '"', "{bad " + KEY,
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, j string")
    got = [r["redacted"] for r in tree.redact_json(df, "j", [AWS, URL]).orderBy("k").collect()]
    ph = f"<REDACTED:aws-access-key:{KEY[-4:]}>"
    assert got == [
        '{"u":"<REDACTED:url-userinfo-credential>ost/x"}', '{"a":"\\ud800 ' + ph + '"}', '{"\\udc00":["' + ph + '"],"n":1e400,"m":100.0}', '{"a":"' + ph + '","a":{"b":"' + ph + '"}}', '  [ "' + ph + '" , 12345678901234567890123 ]', '"' + ph + '"', "{bad " + ph,
    ]
    hits = {r["k"]: r["rules"] for r in tree.all_hits(df, "k", "j", [AWS, URL]).collect()}
    assert set(hits) == set(range(7)) and hits[0] == ["url-userinfo-credential"]


def test_walk_equals_the_engine(spark):
    rng = random.Random(13)

    def node(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind == 0:
            return rng.choice([KEY, "clean", b64(KEY), "ghp_" + "0123456789abcdefghijABCDEFGHIJ012345"])
        if kind < 3:
            return rng.choice([1, 2.5, None, True, "", "é"])
        if kind < 5:
            return {rng.choice("zayébB") + str(k): node(depth - 1) for k in range(rng.randrange(4))}
        return [node(depth - 1) for _ in range(rng.randrange(4))]

    trees = [node(4) for _ in range(120)]
    df = spark.createDataFrame([(k, json.dumps(t, ensure_ascii=rng.random() < 0.5)) for k, t in enumerate(trees)], "k int, j string")
    every = {r["k"]: (sorted(r["rules"]), r["fields"]) for r in tree.all_hits(df, "k", "j", [AWS, PAT], depth=2).collect()}
    first = {r["k"]: (r["field"], r["rules"]) for r in tree.first_hit(df, "k", "j", [AWS, PAT], depth=2).collect()}
    engine = Engine([AWS, PAT])
    for k, t in enumerate(trees):
        ids, fields = engine.all_hits(t)
        assert every.get(k, ([], [])) == (sorted(ids), sorted(fields)) and first.get(k) == engine.first_hit(t)


def test_broken_rows_come_back_whole(spark):
    deep = b64(b64(KEY.encode().hex()))
    df = spark.createDataFrame([(1, f"v {deep}"), (2, f"w {deep}"), (3, None)], "k int, s string")
    df = df.withColumn("s", F.when(F.col("k") == 2, F.concat(F.encode("s", "UTF-8"), F.unhex(F.lit("FF"))).cast("string")).otherwise(F.col("s")))
    fine, failed = split_failed(redact(df, "s", [AWS], errors="error"))
    assert sorted((r["k"], r["rules"]) for r in fine.collect()) == [(1, ["aws-access-key"]), (3, [])]
    r = failed.select("k", F.hex(F.col("redacted").cast("binary")).alias("raw"), "rules", "error").first()
    assert r["k"] == 2 and r["raw"] == f"w {deep}".encode().hex().upper() + "FF" and r["rules"] == [] and "Unicode" in r["error"]


def test_places(spark):
    s = f"é {KEY}\n\n你{KEY} {KEY}\nend " + b64(f"is {KEY}!") + " x"
    rows = locate.find(spark.createDataFrame([(s,)], "s string"), "s", [AWS], decoded=True).collect()
    lines = s.encode().split(b"\n")
    assert [(r["start_line"], r["start_col"]) for r in rows] == [(0, 4), (2, 4), (2, 25), (3, 5)]
    for r in rows:
        assert r["line"].encode() == lines[r["start_line"]] and r["start_line"] == r["end_line"]
        assert lines[r["start_line"]][r["start_col"] - 1 : r["end_col"]].decode() == (r["encoded"] or r["match"])
    cut = lambda *at: locate.segment_at(F.col("s"), *map(F.lit, at))
    got = spark.createDataFrame([("ab\ncé",)], "s string").select(cut(1, 1, 1, 3).alias("a"), cut(0, 1, 1, 1).alias("b"), cut(1, 1, 1, 4).alias("c"), cut(5, 5, 1, 1).alias("d"), cut(0, 0, 1, 2).alias("e")).first()
    assert tuple(got) == ("cé", None, None, None, "ab")


@pytest.mark.parametrize("regex", ["((a+))+b", "(?:(?:a+)b?)+c", "(a|a)*c", "(a+){1,100}c", "x*", "(a|ab)+c", r"(\w+\s?)*e"])
def test_regexes_that_take_too_long(regex):
    with pytest.raises(BadRule):
        catalog.check(Rule("r", regex))


@pytest.mark.parametrize("regex", ["(ab|ac)+d", r"([a-z]+\.)+com", "(?:[0-9]{2}-)+x", "a{1,3}b", "(a|b)*c", "key=(.{4})"])
def test_regexes_that_do_not(regex):
    catalog.check(Rule("r", regex))


def test_skip_paths_of_a_project(spark, tmp_path):
    (tmp_path / catalog.CONFIG_NAME).write_text('skip_paths = ["**/vendored/**"]\n[[rules]]\nid = "gitlab-pat"\nregex = "(glpat-x)"\n')
    c = catalog.load(project_start=str(tmp_path))
    assert c.skip_paths == ("**/vendored/**",) and catalog.project_warning(c) == (["gitlab-pat"], 2)
    event = lambda path: ("claudecode", "pre_tool", "Write", json.dumps({"tool_input": {"file_path": path, "content": KEY}}))
    df = spark.createDataFrame([event("a/vendored/b.py"), event("a/b.py")], "harness string, event string, tool string, payload string")
    assert sorted(r["action"] for r in policy.decide(df, [AWS], policy.Settings(skip=c.skip_paths)).collect()) == ["deny", "pass"]
    (tmp_path / catalog.CONFIG_NAME).write_text("skip_paths = 3\n")
    assert catalog.load(project_start=str(tmp_path)).skip_paths == ()


def test_wrong_typed_entries_and_ranges(spark):
    df = spark.createDataFrame([("a", k, "2026-01-01T00:00:00Z", "t", "x", ["r"], 1, "") for k in range(40)], "log string, n int, ts string, tool string, action string, rules array<string>, count int, field string")
    lines = audit.chain(df, "log", "n")
    for size in (1, 7, 50_000):
        assert {r["kind"] for r in audit.verify(lines, size).collect()} == {"ok"}
    for bad in ('{"ts":1}', '{"rules":"a"}', '{"rules":[1]}', '{"count":"1"}', '{"count":1.5}', '{"hash":{}}', "[]", "7", "{"):
        broken = lines.withColumn("line", F.when(F.col("line_no") == 5, F.lit(bad)).otherwise(F.col("line")))
        kinds = [r["kind"] for r in audit.verify(broken, 5).orderBy("line_no").collect()]
        assert kinds == ["ok"] * 4 + ["parse", "chain"] + ["ok"] * 34, bad


def test_composed_tables_equal_composed_catalogs(spark):
    rng = random.Random(14)
    rows = [(t, rng.choice(catalog.LAYERS), k, f"r{rng.randrange(6)}", f"x{k}") for t in range(4) for k in range(25)]
    off = [(t, f"r{k}") for t in range(4) for k in range(6) if rng.random() < 0.2]
    made = catalogs.composed(spark.createDataFrame(rows, "t int, layer string, place int, rule_id string, regex string"), spark.createDataFrame(off * 2, "t int, rule_id string"), ["t"]).cache()
    for t in range(4):
        c = catalog.compose({name: [Rule(i, x) for tt, layer, _, i, x in rows if tt == t and layer == name] for name in catalog.LAYERS}, {i for tt, i in off if tt == t})
        got = catalogs.effective(made, ["t"]).where(F.col("t") == t).orderBy("place").collect()
        assert [(r["rule_id"], r["regex"], r["source"], r["overridden_from"]) for r in got] == [(r.id, r.regex, r.source, r.overridden_from) for r in c.rules]
        listed = catalogs.listing(made, ["t"]).where(F.col("t") == t).orderBy("place").collect()
        assert [(r["source"], r["rule_id"], r["state"] == "disabled") for r in listed] == [(r.source, r.id, r.disabled) for r in c.listed]


def test_over_a_line_end():
    engine = Engine([AWS])
    assert over_the_end(engine, "x " + KEY[:8], KEY[8:] + " y") == (8, 12, f"<REDACTED:aws-access-key:{KEY[-4:]}>", "aws-access-key")
    assert over_the_end(engine, "x " + KEY, "y") is None and over_the_end(engine, "", KEY) is None


def test_many_writers(spark, tmp_path):
    """Writers that append at once lose nothing; what one that died left isn't read."""
    from concurrent.futures import ThreadPoolExecutor

    from veilspark.operators import commits

    folder = f"file://{tmp_path}/log"
    kind = "log string, n int, ts string, tool string, action string, rules array<string>, count int, field string"

    def entries(writer, batch):
        return spark.createDataFrame([("ab"[k % 2], k, "2026-01-01T00:00:00Z", f"w{writer}", "x", ["r"], 1, f"{batch}-{k}") for k in range(10)], kind)

    spark.createDataFrame([("a", 9, "{}")], "log string, line_no bigint, line string").write.parquet(f"{folder}/lines/dead")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda w: [commits.append(spark, folder, entries(w, b), "log", "n") for b in range(2)], range(4)))
    lines = commits.lines(spark, folder)
    assert len(commits.commits(spark, folder)) == 8 and lines.count() == 80
    assert {r["kind"] for r in audit.verify(lines).collect()} == {"ok"}
    assert lines.select("log", "line_no").distinct().count() == 80 and lines.agg(F.max("line_no")).first()[0] == 40
    told = lines.select(F.get_json_object("line", "$.tool").alias("w"), F.get_json_object("line", "$.field").alias("f")).distinct().count()
    assert told == 80
