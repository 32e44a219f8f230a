"""Queries over the driver's tables, one or more for each operator, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.catalog import Rule, terms_of
from veilspark.functions import paths, text
from veilspark.operators import audit, catalogs, detect, locate, policy, tree
from veilspark.operators.redact import redact, redact_surface
from veilspark.sources.shared import drop_folder, spread
from veilspark.plans.fixtures import AWS, BASE58, KEYED, MIXED, SEEDS

RULES = {r.id: r for r in catalog.builtin("core") + catalog.builtin("pii")}
CORE = [r for r in RULES.values() if not r.id.startswith("pii-")]
MIXED_RULES = [RULES[i] for i in ("aws-access-key", "github-pat-classic", "bearer-token")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _dropped(spark: SparkSession, at: str) -> None:
    """What a stream read, and its state, once it has ended."""
    for part in ("in", "state"):
        drop_folder(spark, f"{at}/{part}")


def _seeded(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """k, h, c: the seeded text for each row of orders."""
    keyed = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.md5(F.col("o_orderkey").cast("string")).alias("h"))
    return keyed.withColumn("c", F.expr(sql))


def _duck_text(sql: str) -> str:
    return f"(select k, h, {sql} as c from {KEYED})"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# DuckDB spellings ---------------------------------------------------------------------


def duck_entropy(s: str) -> str:
    p = f"((length({s}) - length(replace({s}, ch, ''))) / length({s})::double)"
    return f"round(list_sum(list_transform(list_distinct(string_split({s}, '')), lambda ch: -{p} * log2({p}))), 9)"


def duck_gate(rule: Rule, c: str) -> str:
    return "(" + " or ".join(f"contains(lower({c}), {_q(k)})" for k in rule.keywords) + ")" if rule.keywords else "true"


def duck_findings(rule: Rule, c: str) -> str:
    """A list of {m, s} for column c."""
    rx = _q(rule.regex)
    pairs = f"list_transform(range(1, len(regexp_extract_all({c}, {rx}, 0)) + 1), lambda i: {{'m': regexp_extract_all({c}, {rx}, 0)[i], 's': regexp_extract_all({c}, {rx}, 1)[i]}})"
    drop = []
    for t in terms_of(rule):
        if t.kind == "entropy":
            drop.append(f"{duck_entropy('f.s')} <= {t.limit}")
        else:
            drop += [f"regexp_matches(f.s, {_q(v)})" for v in t.values]
    drop += [f"regexp_matches({c}, {_q(x)})" for x in rule.allow]  # seeds are single lines
    kept = f"list_filter({pairs}, lambda f: not ({' or '.join(drop)}))" if drop else pairs
    return f"case when {duck_gate(rule, c)} then {kept} else [] end"


def duck_placeholder(rule: str, s: str) -> str:
    return f"('<REDACTED:' || {_q(rule)} || case when strlen({s}) >= 12 then ':' || right({s}, 4) else '' end || '>')"


# One query for each rule ------------------------------------------------------------------


def _rule_query(rule: Rule):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _seeded(spark, sf_dir, SEEDS[rule.id]).withColumn("low", F.lower("c"))
        df = df.withColumn("f", detect.rule_findings(rule, F.col("c"), F.col("low")))
        return df.select("k", F.size("f").cast("long").alias("n_hits"), F.array_join("f.secret", "|").alias("secrets"))

    return query


for _rule in RULES.values():
    _name = f"rule_{_rule.id.replace('-', '_')}"
    QUERIES[_name] = _rule_query(_rule)
    ORACLES[_name] = f"select k, len(f)::bigint as n_hits, array_to_string(list_transform(f, lambda x: x.s), '|') as secrets from (select k, {duck_findings(_rule, 'c')} as f from {_duck_text(SEEDS[_rule.id])})"


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


# Redaction --------------------------------------------------------------------------------

_M = {r.id: f"coalesce(({duck_findings(r, 'c')})[1].m, '')" for r in MIXED_RULES}
_S = {r.id: f"coalesce(({duck_findings(r, 'c')})[1].s, '')" for r in MIXED_RULES}
_CORE_ORACLE = f"""
with f as (select k, c, {_M['aws-access-key']} as m1, {_S['aws-access-key']} as s1, {_M['github-pat-classic']} as m2, {_S['github-pat-classic']} as s2,
           {_M['bearer-token']} as m3, {_S['bearer-token']} as s3 from {_duck_text(MIXED)}),
a as (select *, case when m1 = '' then c else replace(c, m1, {duck_placeholder('aws-access-key', 's1')}) end as c1 from f),
b as (select *, case when m2 = '' then c1 else replace(c1, m2, {duck_placeholder('github-pat-classic', 's2')}) end as c2 from a)
select k as o_orderkey, case when m3 = '' then c2 else replace(c2, m3, {duck_placeholder('bearer-token', 's3')}) end as redacted,
  array_to_string(list_filter([case when m1 <> '' then 'aws-access-key' end, case when m2 <> '' then 'github-pat-classic' end, case when m3 <> '' then 'bearer-token' end], lambda x: x is not null), ',') as rules from b
"""


def seeded_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = redact_surface(_seeded(spark, sf_dir, MIXED), "c", MIXED_RULES)
    return df.select(F.col("k").alias("o_orderkey"), "redacted", F.array_join("rules", ",").alias("rules"))


query("redact_seeded_core", _CORE_ORACLE)(seeded_core)


@query("redact_all_passes", _CORE_ORACLE)
def _redact_all(spark, sf_dir):
    """The same by all passes, decoding and views included, with the three rules."""
    df = redact(_seeded(spark, sf_dir, MIXED), "c", MIXED_RULES)
    return df.select(F.col("k").alias("o_orderkey"), "redacted", F.array_join("rules", ",").alias("rules"))


_MARKED = "'id=' || " + AWS + " || case k % 4 when 0 then ' # gitleaks:allow' when 1 then repeat('x', 100) || ' gitleaks:allow' when 2 then repeat('x', 106) || 'gitleaks:allow' else chr(10) || 'gitleaks:allow' end"


def _marked(authored: bool):
    def run(spark, sf_dir):
        df = redact_surface(_seeded(spark, sf_dir, _MARKED), "c", [RULES["aws-access-key"]], authored)
        return df.select("k", "redacted", (F.size("rules") > 0).alias("hit"))

    return run


_KEY = f"({AWS})"
_PH = duck_placeholder("aws-access-key", _KEY)
query("marker_authored", f"select k, case when k % 4 in (0, 1, 2) and (k % 4 <> 2 or 106 + 14 <= 120) then c else replace(c, {_KEY}, {_PH}) end as redacted, not (k % 4 in (0, 1, 2) and (k % 4 <> 2 or 106 + 14 <= 120)) as hit from {_duck_text(_MARKED)}")(_marked(True))
query("marker_untrusted", f"select k, replace(c, {_KEY}, {_PH}) as redacted, true as hit from {_duck_text(_MARKED)}")(_marked(False))



@query("marker_suppressed", f"select k, case when k % 4 <> 3 then 'aws-access-key' else '' end as suppressed from {KEYED}")
def _suppressed(spark, sf_dir):
    return detect.suppressed(_seeded(spark, sf_dir, _MARKED), "c", [RULES["aws-access-key"]]).select("k", F.array_join("suppressed", ",").alias("suppressed"))


@query("hint_line", f"select o_orderkey as k, case when rules <> '' then '[veilspark] redacted ' || len(string_split(rules, ',')) || ' secret(s) (' || replace(rules, ',', ', ') || ')' end as hint from ({_CORE_ORACLE})")
def _hint(spark, sf_dir):
    df = redact_surface(_seeded(spark, sf_dir, MIXED), "c", MIXED_RULES)
    return df.select("k", text.hint("veilspark", F.col("rules")).alias("hint"))


_ESC = "chr(27) || '[31m'"
_LEAK_LINE = f"'before' || chr(10) || 'x ' || substr({_KEY}, 1, 8) || {_ESC} || substr({_KEY}, 9, 12) || ' y' || chr(10) || 'after'"
_LEAK_ALL = f"substr({_KEY}, 1, 8) || {_ESC} || substr({_KEY}, 9, 12) || ' y'"


def _leak(sql):
    def run(spark, sf_dir):
        return redact_surface(_seeded(spark, sf_dir, sql), "c", [RULES["aws-access-key"]]).select("k", "redacted", F.array_join("rules", ",").alias("rules"))

    return run


query("leak_backstop_line", f"select k, 'before' || chr(10) || {_PH} || chr(10) || 'after' as redacted, 'aws-access-key' as rules from {KEYED}")(_leak(_LEAK_LINE))
query("leak_backstop_payload", f"select k, {_PH} as redacted, 'aws-access-key' as rules from {KEYED}")(_leak(_LEAK_ALL))


def _encoded(spark_sql: str, duck_sql: str, name: str):
    def run(spark, sf_dir):
        df = redact(_seeded(spark, sf_dir, f"'v ' || {spark_sql} || ' end'"), "c", [RULES["aws-access-key"]])
        return df.select("k", "redacted", F.array_join("rules", ",").alias("rules"))

    query(name, f"select k, 'v ' || {_PH} || ' end' as redacted, 'aws-access-key' as rules from {KEYED}")(run)


_PADDED = f"('key is ' || {_KEY} || '!')"
_PADDED_SQL = f"base64(cast({_PADDED} as binary))"
_DUCK_PADDED = f"to_base64(encode({_PADDED}))"
_encoded(f"base64(cast({_PADDED} as binary))", "", "decoded_base64")
_encoded(f"lower(hex({_PADDED}))", "", "decoded_hex")
_encoded(f"base64(cast(base64(cast({_PADDED} as binary)) as binary))", "", "decoded_base64_twice")
_encoded(f"regexp_replace(hex({_KEY}), '(..)', '%$1')", "", "decoded_percent")
_encoded(f"regexp_replace(hex({_KEY}), '(..)', 'U+00$1')", "", "decoded_unicode")
_encoded(f"base64(cast(base64(cast(lower(hex({_KEY})) as binary)) as binary))", "", "decoded_three_deep")

_OBFUSCATED = {
    "normalized_zero_width": f"'n ' || substr({_KEY}, 1, 6) || '​' || substr({_KEY}, 7, 14)",
    "normalized_delimited_hex": f"'n ' || regexp_replace(regexp_replace(hex({_KEY}), '(..)', '$1-'), '-$', '')",
    "normalized_entities": f"'n &#' || ascii(substr({_KEY}, 1, 1)) || ';' || substr({_KEY}, 2, 19)",
}
for _name, _sql in _OBFUSCATED.items():

    def _normalized(spark, sf_dir, sql=_sql):
        df = _seeded(spark, sf_dir, "'top' || chr(10) || " + sql + " || chr(10) || 'bottom'")
        return redact(df, "c", [RULES["aws-access-key"]]).select("k", "redacted", F.array_join("rules", ",").alias("rules"))

    query(_name, f"select k, 'top' || chr(10) || {_PH} || chr(10) || 'bottom' as redacted, 'aws-access-key' as rules from {KEYED}")(_normalized)

# Places --------------------------------------------------------------------------------------------------

# the tables hold no credentials of their own: each document gets three, two of them the same, beside characters of several bytes
_PLACED = f"coalesce(text, '') || chr(10) || 'é ' || {AWS} || ' 你 🙂' || {AWS} || chr(10) || chr(10) || '“' || 'ghp_' || h || '0123' || '” ' || {AWS}"
_PLACED_RULES = [RULES["aws-access-key"], RULES["github-pat-classic"], RULES["pii-crypto-seed-phrase"]]


def _duck_places(r: Rule) -> str:
    rx = _q(r.regex)
    drop = " and ".join(f"not regexp_matches(s, {_q(v)})" for t in terms_of(r) for v in t.values) or "true"
    split = f"select k, c, regexp_split_to_array(c, {rx}) as between, regexp_extract_all(c, {rx}, 0) as ms, regexp_extract_all(c, {rx}, 1) as ss from placed where {duck_gate(r, 'c')}"
    each = f"select k, c, ms[i] as m, ss[i] as s, array_to_string(list_transform(range(1, i + 1), lambda j: between[j] || case when j < i then ms[j] else '' end), '') as head from (select *, unnest(range(1, len(ms) + 1)) as i from ({split}))"
    line = lambda t: f"len({t}) - len(replace({t}, chr(10), ''))"
    col = lambda t: f"strlen(string_split({t}, chr(10))[-1])"
    return f"select k, {_q(r.id)} as rule_id, {line('head')} as start_line, {col('head')} + 1 as start_col, {line('(head || m)')} as end_line, {col('(head || m)')} as end_col, m as part from ({each}) where {drop}"


@query("findings_at", f"with placed as (select k, {_PLACED} as c from (select doc_id as k, md5(cast(doc_id as varchar)) as h, text from documents)) " + " union all ".join(map(_duck_places, _PLACED_RULES)))
def _findings_at(spark, sf_dir):
    """Where findings are, in bytes, and what the text holds there."""
    df = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.md5(F.col("doc_id").cast("string")).alias("h"), "text").select("k", F.expr(_PLACED).alias("c"))
    part = locate.segment_at(F.col("c"), F.col("start_line"), F.col("end_line"), F.col("start_col"), F.col("end_col"))
    return locate.find(df, "c", _PLACED_RULES).select("k", "rule_id", "start_line", "start_col", "end_line", "end_col", part.alias("part"))


_HIDDEN_AT = f"'ä v=' || {_PADDED_SQL} || ' ü' || chr(10) || 'x ' || {_PADDED_SQL}"


@query("findings_decoded_at", f"select k, 'aws-access-key' as rule_id, 0 as start_line, 6 as start_col, 0 as end_line, 5 + strlen(e) as end_col, {_KEY} as secret from (select k, h, {_DUCK_PADDED} as e from {KEYED})")
def _findings_decoded_at(spark, sf_dir):
    """The place of what's decoded is its segment's."""
    df = locate.find(_seeded(spark, sf_dir, _HIDDEN_AT), "c", [RULES["aws-access-key"]], decoded=True)
    return df.where(locate.segment_at(F.col("c"), F.col("start_line"), F.col("end_line"), F.col("start_col"), F.col("end_col")) == F.col("encoded")).select("k", "rule_id", "start_line", "start_col", "end_line", "end_col", "secret")


# Repeated matches, odd texts ---------------------------------------------------------------------------------

_ALLOWED_TWICE = f"'pay 1' || {BASE58} || ' genesis block' || case when k % 3 > 0 then chr(10) || 'pay 1' || {BASE58} || ' now' else '' end"
_BTC_PH = duck_placeholder("pii-btc-p2pkh", f"('1' || {BASE58})")


@query("allowlist_by_occurrence", f"select k, case when k % 3 > 0 then replace({_ALLOWED_TWICE}, '1' || {BASE58}, {_BTC_PH}) else {_ALLOWED_TWICE} end as redacted, case when k % 3 > 0 then 1 else 0 end as n from {KEYED}")
def _allowed_twice(spark, sf_dir):
    """A value on an allowed line and on another one is a finding, and all its copies go."""
    rule = RULES["pii-btc-p2pkh"]
    df = redact_surface(_seeded(spark, sf_dir, _ALLOWED_TWICE), "c", [rule])
    return df.select("k", "redacted", F.size(detect.rule_findings(rule, F.col("c"), F.lower("c"))).alias("n"))


_MARKED_TWICE = f"{AWS} || ' # gitleaks:allow' || case when k % 3 > 0 then chr(10) || 'plain ' || {AWS} || ' here' else '' end"
for _name, _made in (("marker_by_occurrence", redact_surface), ("marker_by_occurrence_all_passes", redact)):

    @query(_name, f"select k, case when k % 3 > 0 then replace({_MARKED_TWICE}, {_KEY}, {_PH}) else {_MARKED_TWICE} end as redacted from {KEYED}")
    def _marked_twice(spark, sf_dir, made=_made):
        """A value near a marker and elsewhere without one is a finding, and all its copies go."""
        return made(_seeded(spark, sf_dir, _MARKED_TWICE), "c", [RULES["aws-access-key"]], True).select("k", "redacted")


_IMAGE = f"'data:image/png;base64,' || repeat('iVBORw0KGgoAAAANSUhEUgAAAAUAAAAFCAYAAACNbyblAAAAHElEQVQI12P4', 500) || ' %zz ' || {_PADDED_SQL}"


@query("decoded_beside_image", f"select k, 'aws-access-key' as rules, left(replace({_IMAGE.replace(_PADDED_SQL, 'e')}, e, {_PH}), 40) as head, md5(replace({_IMAGE.replace(_PADDED_SQL, 'e')}, e, {_PH})) as digest from (select k, h, {_DUCK_PADDED} as e from {KEYED})")
def _beside_image(spark, sf_dir):
    """A text of 30 KB that's mostly one run of letters takes no longer than others."""
    df = redact(_seeded(spark, sf_dir, _IMAGE), "c", [RULES["aws-access-key"]], native=True)
    return df.select("k", F.array_join("rules", ",").alias("rules"), F.left("redacted", F.lit(40)).alias("head"), F.md5("redacted").alias("digest"))


_DEEP = f"base64(cast(base64(cast(lower(hex({_KEY})) as binary)) as binary))"


_FAILING = f"case when k % 5 = 0 then cast(concat(cast('é' as binary), unhex('FF'), cast(' ' || {_DEEP} as binary)) as string) else 'v ' || {_DEEP} end"


@query("dead_letters", f"select k % 5 = 0 as failed, count(*) as n, sum(case when k % 5 = 0 then 5 + strlen(e) - 1 else strlen('v ' || {_PH}) end)::bigint as n_bytes from (select k, h, to_base64(encode(to_base64(encode(lower(hex({_KEY})))))) as e from {KEYED}) group by all")
def _dead_letters(spark, sf_dir):
    """A stream's lines that fail, and the others, in files of their own."""
    from veilspark.sources.shared import new_folder
    from veilspark.sources.text import write_dead_letters
    from veilspark.streaming.lines import redact_lines, run

    at = new_folder(spark)
    _seeded(spark, sf_dir, _FAILING).select("k", "c").write.parquet(f"{at}/in")
    stream = redact_lines(spark.readStream.schema("k long, c string").parquet(f"{at}/in"), [RULES["aws-access-key"]], "c", errors="error")
    fine = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    run(stream, fine, f"{at}/state", dead=lambda df, n: write_dead_letters(df, f"{at}/dead/batch={n}", "redacted", mode="overwrite")).awaitTermination()
    _dropped(spark, at)
    counts = lambda path, failed: spark.read.parquet(path).agg(F.lit(failed).alias("failed"), F.count("*").alias("n"), F.sum(F.octet_length("redacted")).alias("n_bytes"))
    return counts(f"{at}/out", False).unionByName(counts(f"{at}/dead", True))


@query("error_channel", f"select k, case when k % 5 = 0 then hex('é') || 'FF' || hex(' ' || e) else hex('v ' || {_PH}) end as redacted, case when k % 5 = 0 then '' else 'aws-access-key' end as rules, k % 5 = 0 as failed from (select k, h, to_base64(encode(to_base64(encode(lower(hex({_KEY})))))) as e from {KEYED})")
def _error_channel(spark, sf_dir):
    """Texts that aren't UTF-8, and that only the engine could finish, come back whole with an error; others are redacted."""
    df = redact(_seeded(spark, sf_dir, _FAILING), "c", [RULES["aws-access-key"]], errors="error")
    return df.select("k", F.hex(F.col("redacted").cast("binary")).alias("redacted"), F.array_join("rules", ",").alias("rules"), F.col("error").isNotNull().alias("failed"))


# Findings in the tables ---------------------------------------------------------------------------

_TEXTS = {"documents": "doc_id", "conversations": "conv_id", "benchmark": "item_id"}


@query(
    "findings_pii_documents",
    "select doc_id, rule_id, n from (" + " union all ".join(f"select doc_id, {_q(r.id)} as rule_id, len({duck_findings(r, 'text')})::bigint as n from documents" for r in RULES.values() if r.id in ("pii-crypto-seed-phrase", "pii-credit-card", "pii-bank-account", "pii-eth-raw-privkey", "pii-ssn")) + ") where n > 0",
)
def _findings_documents(spark, sf_dir):
    rules = [RULES[i] for i in ("pii-crypto-seed-phrase", "pii-credit-card", "pii-bank-account", "pii-eth-raw-privkey", "pii-ssn")]
    df = _table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    found = df.select("doc_id", F.explode(detect.findings(rules, F.col("text"), F.col("low"))).alias("f"))
    return found.groupBy("doc_id", F.col("f.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


# the tables hold no credentials of their own, so each text gets one, of the rule whose turn it is
_PLANTED = "text || chr(10) || case k % " + str(len(CORE)) + "".join(f" when {n} then {SEEDS[r.id]}" for n, r in enumerate(CORE)) + " end"


def _planted_duck(table: str, key: str) -> str:
    return f"(select k, {_PLANTED} as text from (select {key} as k, md5(cast({key} as varchar)) as h, text from {table}))"


@query("findings_core_all_texts", " union all ".join(f"select '{t}' as tbl, {_q(r.id)} as rule_id, sum(len({duck_findings(r, 'text')}))::bigint as n from {_planted_duck(t, key)} group by all having n > 0" for t, key in _TEXTS.items() for r in CORE))
def _findings_all(spark, sf_dir):
    out = None
    for name, key in _TEXTS.items():
        df = _table(spark, sf_dir, name).select(F.col(key).alias("k"), F.md5(F.col(key).cast("string")).alias("h"), "text")
        df = df.select(F.expr(_PLANTED).alias("text")).withColumn("low", F.lower("text"))
        # no filter on the gates: below it, each would lower the text anew
        df = df.select(F.lit(name).alias("tbl"), F.explode(detect.findings(CORE, F.col("text"), F.col("low"))).alias("f"))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("tbl", F.col("f.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


_SEED_PHRASE = RULES["pii-crypto-seed-phrase"]


@query("hits_by_source_lang", f"select source, lang, sum(len({duck_findings(_SEED_PHRASE, 'text')}))::bigint as n, count(*)::bigint as docs from documents group by all")
def _hits_by_source(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    n = F.size(detect.rule_findings(_SEED_PHRASE, F.col("text"), F.col("low")))
    return df.select("source", "lang", n.alias("n")).groupBy("source", "lang").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("docs"))


@query("hits_by_label", f"select toxic, quality, sum(len({duck_findings(_SEED_PHRASE, 'text')}))::bigint as n, count(*)::bigint as docs from documents join labels using (doc_id) group by all")
def _hits_by_label(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").withColumn("low", F.lower("text"))
    n = F.size(detect.rule_findings(_SEED_PHRASE, F.col("text"), F.col("low")))
    return df.select("toxic", "quality", n.alias("n")).groupBy("toxic", "quality").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("docs"))


@query("hits_hourly", "select date_trunc('hour', ts) as hour, event_type, count(*)::bigint as n from events where regexp_matches(props, '[0-9]{2}') group by all")
def _hits_hourly(spark, sf_dir):
    df = _table(spark, sf_dir, "events").where(F.col("props").rlike("[0-9]{2}"))
    return df.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("top_rules", "select rule_id, n from (" + " union all ".join(f"select {_q(r.id)} as rule_id, sum(len({duck_findings(r, 'text')}))::bigint as n from documents" for r in RULES.values() if r.id.startswith("pii-")) + ") where n > 0 order by n desc, rule_id limit 3")
def _top_rules(spark, sf_dir):
    rules = [r for r in RULES.values() if r.id.startswith("pii-")]
    df = _table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    found = df.select(F.explode(detect.findings(rules, F.col("text"), F.col("low"))).alias("f"))
    return found.groupBy(F.col("f.rule_id").alias("rule_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(3)


# Scalar operators -----------------------------------------------------------------------------------

_ANSI_SQL = f"{_ESC} || {_KEY} || chr(27) || '[0m' || chr(27) || ']0;title' || chr(7) || ' tail' || chr(27) || 'M'"


@query("strip_ansi", f"select k, {_KEY} || ' tail' as s from {KEYED}")
def _strip_ansi(spark, sf_dir):
    return _seeded(spark, sf_dir, _ANSI_SQL).select("k", text.strip_ansi(F.col("c")).alias("s"))


@query("strip_invisible", f"select k, {_KEY} || ' z' as s from {KEYED}")
def _strip_invisible(spark, sf_dir):
    return _seeded(spark, sf_dir, f"substr({_KEY}, 1, 4) || '​⁦' || substr({_KEY}, 5, 16) || '­ z'").select("k", text.strip_invisible(F.col("c")).alias("s"))


@query("collapse_hex", f"select k, 'm ' || hex(substr(h, 1, 6)) || 'ab:c' as s from {KEYED}")
def _collapse_hex(spark, sf_dir):
    return _seeded(spark, sf_dir, "'m ' || regexp_replace(regexp_replace(hex(substr(h, 1, 6)), '(..)', '$1:'), ':$', '') || ' ab:c'").select("k", text.collapse_hex(F.col("c")).alias("s"))


@query("html_entities_numeric", f"select k, '<' || substr(h, 1, 4) || '>&amp;é€' || h as s from {KEYED}")
def _entities(spark, sf_dir):
    return _seeded(spark, sf_dir, "'&#60;' || substr(h, 1, 4) || '&#x3E;&#38;amp;&#233;&#128;' || h").select("k", text.decode_entities(F.col("c")).alias("s"))


@query("html_entities_pages", "select page_id, replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&') as s from pages")
def _entities_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.decode_entities(F.col("html")).alias("s"))


@query("entropy_secret", f"select k, {duck_entropy('h')} as bits from {KEYED}")
def _entropy(spark, sf_dir):
    return _seeded(spark, sf_dir, "h").select("k", F.round(text.entropy(F.col("h")), 9).alias("bits"))


@query("placeholder", f"select k, case when k % 2 = 0 then '<REDACTED:my-rule:' || right(h, 4) || '>' else '<REDACTED:secret>' end as s from {KEYED}")
def _placeholder(spark, sf_dir):
    df = _seeded(spark, sf_dir, "case when k % 2 = 0 then h else substr(h, 1, 11) end")
    return df.select("k", text.placeholder(F.when(F.col("k") % 2 == 0, F.lit("My Rule")).otherwise(F.lit("")), F.col("c"), F.lit("")).alias("s"))


@query("line_starts", "select doc_id, array_to_string(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: coalesce(list_sum(list_transform(list_slice(string_split(text, chr(10)), 1, i - 1), lambda x: strlen(x) + 1)), 0)::bigint), ',') as starts from documents")
def _line_starts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(text.line_starts(F.col("text")), lambda x: x.cast("string")), ",").alias("starts"))


_WORDS = "case k % 4 when 0 then h when 1 then 'it''s ' || h when 2 then '' else 'a$' || substr(h, 1, 3) end"


@query("shell_quote_unquote", f"select k, case when c = '' then '''''' when regexp_matches(c, '[ $'']') then '''' || replace(c, '''', '''\\''''') || '''' else c end as quoted, c as back from {_duck_text(_WORDS)}")
def _shell(spark, sf_dir):
    df = _seeded(spark, sf_dir, _WORDS).withColumn("quoted", text.shell_quote(F.col("c")))
    return df.select("k", "quoted", text.shell_unquote(F.col("quoted")).alias("back"))


@query("wrap_unwrap", f"select k, 'veilspark run -- bash -c ' || '''echo ' || h || '''' as wrapped, 'echo ' || h as inner_command, true as again from {KEYED}")
def _wrap(spark, sf_dir):
    df = _seeded(spark, sf_dir, "'echo ' || h").withColumn("wrapped", text.wrap_command("veilspark", F.col("c"), F.lit(False)))
    return df.select("k", "wrapped", text.unwrap_command("veilspark", F.col("wrapped")).alias("inner_command"), text.already_wrapped("veilspark", F.col("wrapped")).alias("again"))


@query("short_forms", f"select k, substr(h, 1, 12) || '…' as hash, h || '.txt' as path from {KEYED}")
def _short(spark, sf_dir):
    return _seeded(spark, sf_dir, "'/long/folder/' || h || '.txt'").select("k", text.short_hash(F.col("h")).alias("hash"), text.short_path(F.col("c")).alias("path"))


# Paths and tools --------------------------------------------------------------------------------------

_PATH = "case k % 8 when 0 then 'src/tests/' || h || '.py' when 1 then 'a/b_test.go' when 2 then h || '.snap' when 3 then 'src/main.go' when 4 then 'testdata/x' when 5 then 'mytests/x.py' when 6 then 'test_' || h || '.py' else 'src/x.golden/y' end"
_TOOL = "case k % 6 when 0 then 'mcp__srv__get' when 1 then 'WebFetch' when 2 then 'bash' when 3 then 'apply_patch' when 4 then 'github_search' else 'custom' end"


@query("skip_paths", f"select k, k % 8 in (0, 1, 2, 4, 6) as skip from {KEYED}")
def _skip(spark, sf_dir):
    return _seeded(spark, sf_dir, _PATH).select("k", paths.skipped(F.col("c")).alias("skip"))


@query("tool_glob", f"select k, k % 6 in (0, 4) as allowed from {KEYED}")
def _tool_glob(spark, sf_dir):
    return _seeded(spark, sf_dir, _TOOL).select("k", paths.tool_matches(F.col("c"), ("mcp__*__get", "*search", "exact")).alias("allowed"))


@query("exfil_class", f"select k, k % 6 in (0, 1, 4) as sends_out, k % 6 = 0 as of_server from {KEYED}")
def _exfil(spark, sf_dir):
    return _seeded(spark, sf_dir, _TOOL).select("k", paths.sends_out(F.col("c")).alias("sends_out"), paths.of_server(F.col("c")).alias("of_server"))


# Catalog ------------------------------------------------------------------------------------------------

# the orders of each hundredth of the customers are the rules of a catalog, in five layers; some of them disable rules
_RULE_ROWS = "select o_custkey % 100 as tenant, case o_orderkey % 5 when 0 then 'upstream' when 1 then 'embedded' when 2 then 'user' when 3 then 'project' else 'env' end as layer, o_orderkey as place, 'rule-' || (o_orderkey % 13) as rule_id, substr(md5(cast(o_orderkey as string)), 1, 8) as regex from orders"
_OFF_ROWS = "select distinct o_custkey % 100 as tenant, 'rule-' || (o_orderkey % 13) as rule_id from orders where o_orderkey % 11 = 0"
_COMPOSED = f"""r as (select *, list_position(['upstream', 'embedded', 'user', 'project', 'env'], layer) as l from ({_RULE_ROWS})),
top as (select *, row_number() over (partition by tenant, rule_id order by l desc, place desc) as n, max(l) over (partition by tenant, rule_id) as best,
        row_number() over (partition by tenant, rule_id order by l, place) as m from r),
firsts as (select tenant, rule_id, l as fl, place as fp from top where m = 1),
lower_ as (select tenant, rule_id, arg_max(layer, l) as overridden_from from top where l < best group by tenant, rule_id),
c as (select t.tenant, t.rule_id, t.regex, t.layer as source, t.l, coalesce(lower_.overridden_from, '') as overridden_from, fl, fp, o.rule_id is not null as off
      from top t join firsts using (tenant, rule_id) left join lower_ using (tenant, rule_id) left join ({_OFF_ROWS}) o on o.tenant = t.tenant and o.rule_id = t.rule_id where t.n = 1)"""


def _composed(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    layer = F.get(F.array(*map(F.lit, catalog.LAYERS)), (F.col("o_orderkey") % 5).cast("int"))
    rules = orders.select((F.col("o_custkey") % 100).alias("tenant"), layer.alias("layer"), F.col("o_orderkey").alias("place"), F.concat(F.lit("rule-"), F.col("o_orderkey") % 13).alias("rule_id"), F.left(F.md5(F.col("o_orderkey").cast("string")), F.lit(8)).alias("regex"))
    off = orders.where("o_orderkey % 11 = 0").select((F.col("o_custkey") % 100).alias("tenant"), F.concat(F.lit("rule-"), F.col("o_orderkey") % 13).alias("rule_id"))
    return catalogs.composed(rules, off, ["tenant"])


@query("catalog_effective", f"with {_COMPOSED} select tenant, row_number() over (partition by tenant order by fl, fp, rule_id) as place, rule_id, regex, source, overridden_from from c where not off")
def _catalog(spark, sf_dir):
    """The rules in force of each catalog, in the order that findings are applied."""
    return catalogs.effective(_composed(spark, sf_dir), ["tenant"])


@query("catalog_listing", f"with {_COMPOSED} select tenant, row_number() over (partition by tenant order by l, rule_id) as place, source, rule_id, case when off then 'disabled' when overridden_from <> '' then 'overrides ' || overridden_from else 'active' end as state from c")
def _listing(spark, sf_dir):
    return catalogs.listing(_composed(spark, sf_dir), ["tenant"])


@query("catalog_project_warning", f"""with {_COMPOSED}, ids as (select tenant, string_agg(rule_id, ',' order by rule_id) as rules, count(*) as n from c where source = 'project' and overridden_from <> '' group by tenant),
s as (select o_custkey % 100 as tenant, count(*) as m from orders where o_orderpriority = '1-URGENT' group by all)
select coalesce(ids.tenant, s.tenant) as tenant, coalesce(rules, '') as rules, coalesce(n, 0) + coalesce(m, 0) as n from ids full join s using (tenant)""")
def _project_warning(spark, sf_dir):
    """Catalogs that their project layer weakens, by overriding rules or by skip patterns (here: urgent orders)."""
    skips = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 100).alias("tenant"))
    return catalogs.project_warnings(_composed(spark, sf_dir), skips, ["tenant"]).select("tenant", F.array_join("rules", ",").alias("rules"), F.col("count").cast("long").alias("n"))


@query("project_skip_paths", f"select k, case when k % 4 in (0, 2) then 'pass' else 'deny' end as action from {KEYED}")
def _project_skip(spark, sf_dir):
    """Skip patterns of a project's file reach the router."""
    skip = catalog.skip_paths('skip_paths = ["**/vendored/**", "*.lock"]')
    path = "case k % 4 when 0 then 'src/vendored/a.py' when 1 then 'src/a.py' when 2 then 'yarn.lock' else 'lock/a.py' end"
    payload = f"""'{{"tool_input":{{"file_path":"' || {path} || '","content":"k=' || {_KEY} || '"}}}}'"""
    df = _seeded(spark, sf_dir, payload).select("k", F.lit("claudecode").alias("harness"), F.lit("pre_tool").alias("event"), F.lit("Write").alias("tool"), F.col("c").alias("payload"))
    return policy.decide(df, [RULES["aws-access-key"]], policy.Settings(skip=skip), only_actions=True).select("k", "action")


# Trees ----------------------------------------------------------------------------------------------------

_TREE = f"'{{\"user\":{{\"note\":\"' || case when k % 3 = 0 then 'clean' else {_KEY} end || '\",\"n\":3}},\"list\":[\"x\",null,true,{{\"t\":\"ghp_' || h || '0123\"}}],\"' || {_KEY} || '\":\"v\"}}'"
_TREE_RULES = [RULES["aws-access-key"], RULES["github-pat-classic"]]


@query("tree_all_hits", f"select k, case when k % 3 = 0 then 'github-pat-classic' else 'aws-access-key,github-pat-classic' end as rules, case when k % 3 = 0 then 'list[3].t' else 'list[3].t,user.note' end as fields from {KEYED}")
def _all_hits(spark, sf_dir):
    return tree.all_hits(_seeded(spark, sf_dir, _TREE), "k", "c", _TREE_RULES).select("k", F.array_join("rules", ",").alias("rules"), F.array_join("fields", ",").alias("fields"))


@query("tree_first_hit", f"select k, 'list[3].t' as field, 'github-pat-classic' as rules from {KEYED}")
def _first_hit(spark, sf_dir):
    return tree.first_hit(_seeded(spark, sf_dir, _TREE), "k", "c", _TREE_RULES).select("k", "field", F.array_join("rules", ",").alias("rules"))


_NESTED = """'{"z":"' || event_type || '","l":[1,"x' || event_id || '",[],{"d d":"t' || user_id || '","e":null}],"p":' || props || ',"b":true}'"""


@query("tree_leaves", f"select event_id, replace(replace(substr(fullkey, 3), '\"', ''), '$', '') as path, atom ->> '$' as value from (select event_id, {_NESTED} as c from events), json_tree(c) where type = 'VARCHAR'")
def _leaves(spark, sf_dir):
    """Every string of nested JSON about the events, and the path to it."""
    return tree.leaves(_table(spark, sf_dir, "events").select("event_id", F.expr(_NESTED).alias("c")), "event_id", "c")


@query("tree_surface_hits", f"select k, 'github-pat-classic' as rules, 'list[3].t' as field from {KEYED}")
def _surface_hits(spark, sf_dir):
    """The first hits without the engine: no Python runs."""
    return tree.first_hit(_seeded(spark, sf_dir, _TREE), "k", "c", _TREE_RULES, depth=0).select("k", "field", F.array_join("rules", ",").alias("rules"))


_HIDDEN = f"""'{{"a":["x","' || regexp_replace(regexp_replace(hex({_KEY}), '(..)', '$1-'), '-$', '') || '"],"b":{{"c":"' || lower(hex('key ' || {_KEY})) || '","d":"' || h || '"}}}}'"""


@query("tree_hidden_hits", f"select k, 'aws-access-key' as rules, 'a[1],b.c' as fields, 'a[1]' as first_field from {KEYED}")
def _hidden_hits(spark, sf_dir):
    """Leaves whose secrets only views and decoding show."""
    found = tree.hits(_seeded(spark, sf_dir, _HIDDEN), "k", "c", _TREE_RULES)
    return found.select("k", F.array_join("rules", ",").alias("rules"), F.array_join("fields", ",").alias("fields"), F.col("field").alias("first_field"))


@query("tree_depth", f"select k, case when k % 2 = 0 then 'aws-access-key' else '' end as rules from {KEYED}")
def _depth(spark, sf_dir):
    """Strings at levels 64 and 65."""
    df = _seeded(spark, sf_dir, f"repeat('[', 64) || case when k % 2 = 0 then '' else '[' end || '\"' || {_KEY} || '\"' || repeat(']', 64) || case when k % 2 = 0 then '' else ']' end")
    return tree.redact_json(df, "c", _TREE_RULES).select("k", F.array_join("rules", ",").alias("rules"))


@query("tree_not_json", f"select k, 'got ' || {_PH} || ' {{' as redacted from {KEYED}")
def _not_json(spark, sf_dir):
    return tree.redact_json(_seeded(spark, sf_dir, f"'got ' || {_KEY} || ' {{'"), "c", _TREE_RULES).select("k", "redacted")


@query("short_secret", f"select k, '<REDACTED:pin>' || chr(10) || 'x' || lpad(cast(k % 10000 as varchar), 4, '0') || '_ ok' as redacted from {KEYED}")
def _short_secret(spark, sf_dir):
    """A secret of a few bytes counts as left only where it's a word of its own."""
    pin = "lpad(cast(k % 10000 as string), 4, '0')"
    df = _seeded(spark, sf_dir, f"'pin=' || {pin} || ' and ' || {pin} || chr(10) || 'x' || {pin} || '_ ok'")
    return redact_surface(df, "c", [Rule("pin", r"pin=([0-9]{4})")]).select("k", "redacted")


_PAT_PH = duck_placeholder("github-pat-classic", "('ghp_' || h || '0123')")


@query("tree_redact_dynamic", f"""select k, '{{"user":{{"note":"' || case when k % 3 = 0 then 'clean' else {_PH} end || '","n":3}},"list":["x",null,true,{{"t":"' || {_PAT_PH} || '"}}],"' || {_KEY} || '":"v"}}' as redacted,
  case when k % 3 = 0 then 'github-pat-classic' else 'aws-access-key,github-pat-classic' end as rules from {KEYED}""")
def _tree_dynamic(spark, sf_dir):
    df = tree.redact_json(_seeded(spark, sf_dir, _TREE), "c", _TREE_RULES)
    return df.select("k", "redacted", F.array_join("rules", ",").alias("rules"))


@query("tree_redact_typed", f"select k, {_PH} as note, 3 as n, 'x,' || {_PAT_PH} as list from {KEYED}")
def _tree_typed(spark, sf_dir):
    df = _seeded(spark, sf_dir, "h").select("k", F.expr(f"struct({_KEY} as note, 3 as n, array('x', 'ghp_' || h || '0123') as list)").alias("v"))
    df = tree.redact_typed(df, "v", _TREE_RULES)
    return df.select("k", "redacted.note", "redacted.n", F.array_join("redacted.list", ",").alias("list"))


_BACK = "chr(92)"
_ESCAPED = f"""'{{"u":"https:' || {_BACK} || '/' || {_BACK} || '/user:' || substr(h,1,12) || '@host' || {_BACK} || '/x","n":[1e400,100.0,12345678901234567890123456789],"s":"' || {_BACK} || 'ud800 ok","k":"AK' || {_BACK} || 'u0049A' || substr({_KEY}, 5, 16) || '", "u":"' || {_KEY} || '"}}'"""

_ESCAPED_ONCE = _ESCAPED.replace(""", "u":"' || """ + _KEY + """ || '"}'""", "}'")


@query("tree_escaped", f"""select k, '{{"u":"' || {duck_placeholder("url-userinfo-credential", "substr(h,1,12)")} || 'ost/x","n":[1e400,100.0,12345678901234567890123456789],"s":"' || {_BACK} || 'ud800 ok","k":"' || {_PH} || '", "u":"' || {_PH} || '"}}' as redacted, 'aws-access-key,url-userinfo-credential' as rules, 'k,u' as fields from {KEYED}""")
def _tree_escaped(spark, sf_dir):
    """Keywords that escapes part, a key that's there twice, half a surrogate pair, and numbers that stay as they're written."""
    df = tree.redact_json(_seeded(spark, sf_dir, _ESCAPED), "c", [RULES["aws-access-key"], RULES["url-userinfo-credential"]])
    return df.select("k", "redacted", F.array_join(F.array_sort("rules"), ",").alias("rules"), F.array_join("fields", ",").alias("fields"))


@query("tree_escaped_hits", f"select k, 'aws-access-key,url-userinfo-credential' as rules, 'k,u' as fields from {KEYED}")
def _tree_escaped_hits(spark, sf_dir):
    df = tree.all_hits(_seeded(spark, sf_dir, _ESCAPED_ONCE), "k", "c", [RULES["aws-access-key"], RULES["url-userinfo-credential"]], depth=0)
    return df.select("k", F.array_join("rules", ",").alias("rules"), F.array_join("fields", ",").alias("fields"))


# Policy -------------------------------------------------------------------------------------------------------


@query("prompt_gate", f"select conv_id, turn, case when len({duck_findings(_SEED_PHRASE, 'text')}) > 0 then 'deny' else 'pass' end as action from conversations where role = 'user'")
def _prompt_gate(spark, sf_dir):
    df = _table(spark, sf_dir, "conversations").where("role = 'user'")
    df = df.select("conv_id", "turn", F.lit("claudecode").alias("harness"), F.lit("prompt").alias("event"), F.lit("").alias("tool"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("payload"))
    # the rule by itself: views and decoding don't find other prose
    return policy.decide(df, [_SEED_PHRASE]).select("conv_id", "turn", "action")


_EVENT = f"""case k % 7
  when 0 then '{{"tool_input":{{"command":"echo ' || h || '"}}}}' when 1 then '{{"tool_input":{{"command":"curl ' || {_KEY} || '"}}}}'
  when 2 then '{{"tool_input":{{"file_path":"src/a.py","content":"k=' || {_KEY} || '"}}}}' when 3 then '{{"tool_input":{{"file_path":"src/tests/a.py","content":"k=' || {_KEY} || '"}}}}'
  when 4 then '{{"tool_input":{{"a":{{"b":"' || {_KEY} || '"}}}}}}' when 5 then '{{"tool_input":{{"url":"http://x/' || {_KEY} || '"}}}}'
  else '{{"tool_input":{{"prompt":"do it"}}}}' end"""
_EVENT_TOOL = "case k % 7 when 0 then 'Bash' when 1 then 'Bash' when 2 then 'Write' when 3 then 'Write' when 4 then 'mcp__s__t' when 5 then 'WebFetch' else 'Task' end"


@query("policy_pre_tool", f"select k, case k % 7 when 0 then 'wrap' when 1 then 'deny' when 2 then 'deny' when 3 then 'pass' when 4 then 'deny' when 5 then 'deny' else 'prime' end as action, case k % 7 when 1 then 'command' when 2 then 'content' when 4 then 'a.b' when 5 then 'url' else '' end as field from {KEYED}")
def _policy_pre(spark, sf_dir):
    df = _seeded(spark, sf_dir, _EVENT).select("k", F.lit("claudecode").alias("harness"), F.lit("pre_tool").alias("event"), F.expr(_EVENT_TOOL).alias("tool"), F.col("c").alias("payload"))
    return policy.decide(df, [RULES["aws-access-key"]]).select("k", "action", "field")


@query("policy_post_tool", f"""select k, case when k % 2 = 0 then 'rewrite' else 'pass' end as action, case when k % 2 = 0 then '{{"out":"' || {_PH} || '"}}' end as updated from {KEYED}""")
def _policy_post(spark, sf_dir):
    payload = f"""'{{"tool_response":{{"out":"' || case when k % 2 = 0 then {_KEY} else h end || '"}}}}'"""
    df = _seeded(spark, sf_dir, payload).select("k", F.lit("claudecode").alias("harness"), F.lit("post_tool").alias("event"), F.lit("WebFetch").alias("tool"), F.col("c").alias("payload"))
    return policy.decide(df, [RULES["aws-access-key"]]).select("k", "action", "updated")


@query("policy_paused", f"select k, 'pass' as action from {KEYED}")
def _policy_paused(spark, sf_dir):
    df = _seeded(spark, sf_dir, _EVENT).select("k", F.lit("claudecode").alias("harness"), F.lit("pre_tool").alias("event"), F.expr(_EVENT_TOOL).alias("tool"), F.col("c").alias("payload"))
    return policy.decide(df, [RULES["aws-access-key"]], policy.Settings(paused_until="2999-01-01 00:00:00")).select("k", "action")


@query("policy_warn_only", f"select k, case k % 7 when 0 then 'wrap' when 1 then 'deny' when 3 then 'pass' when 6 then 'prime' else 'warn' end as action from {KEYED}")
def _policy_warn(spark, sf_dir):
    df = _seeded(spark, sf_dir, _EVENT).select("k", F.lit("claudecode").alias("harness"), F.lit("pre_tool").alias("event"), F.expr(_EVENT_TOOL).alias("tool"), F.col("c").alias("payload"))
    return policy.decide(df, [RULES["aws-access-key"]], policy.Settings(warn_only=True), only_actions=True).select("k", "action")


@query("policy_tool_calls", f"select k, case when k % 6 = 0 then 'deny' else 'pass' end as pi, case when k % 6 in (0, 1, 4) then 'deny' else 'pass' end as opencode from {KEYED}")
def _policy_calls(spark, sf_dir):
    made = None
    for harness, event, part in (("pi", "tool_call", "input"), ("opencode", "before", "args")):
        df = _seeded(spark, sf_dir, f"""'{{"{part}":{{"q":"' || {_KEY} || '"}}}}'""")
        df = df.select("k", F.lit(harness).alias("harness"), F.lit(event).alias("event"), F.expr(_TOOL.replace("custom", "grep")).alias("tool"), F.col("c").alias("payload"))
        made = df if made is None else made.unionByName(df)
    decided = policy.decide(made, [RULES["aws-access-key"]])
    action = lambda h: F.max(F.when(F.col("harness") == h, F.col("action"))).alias(h)
    return decided.groupBy("k").agg(action("pi"), action("opencode"))


def _denied(field: str, tool: str) -> str:
    return f"""'{{"hookSpecificOutput":{{"hookEventName":"PreToolUse","permissionDecision":"deny","permissionDecisionReason":"field {field} of {tool} contains an apparent aws-access-key"}}}}'"""


_DECIDED = f"""select k, case k % 7
  when 0 then '{{"hookSpecificOutput":{{"hookEventName":"PreToolUse","updatedInput":{{"command":"veilspark run -- bash -c ''echo ' || h || '''"}}}}}}'
  when 1 then {_denied('command', 'Bash')} when 2 then {_denied('content', 'Write')} when 3 then '{{}}' when 4 then {_denied('a.b', 'mcp__s__t')} when 5 then {_denied('url', 'WebFetch')}
  else '{{"hookSpecificOutput":{{"hookEventName":"PreToolUse","updatedInput":{{"prompt":"{policy.PRIMING}\\n\\n---\\n\\ndo it"}}}}}}' end as decision from {KEYED}"""


@query("decision_json", _DECIDED)
def _decision_json(spark, sf_dir):
    df = _seeded(spark, sf_dir, _EVENT).select("k", F.lit("claudecode").alias("harness"), F.lit("pre_tool").alias("event"), F.expr(_EVENT_TOOL).alias("tool"), F.col("c").alias("payload"))
    d = policy.decide(df, [RULES["aws-access-key"]])
    return d.select("k", policy.decision_json(F.col("harness"), F.col("event"), F.col("action"), F.col("reason"), F.col("updated")).alias("decision"))


@query("language_prefix", f"select k, case when k % 2 = 0 then 'sh:' else '' end as prefix, h as rest from {KEYED}")
def _language(spark, sf_dir):
    df = _seeded(spark, sf_dir, "case when k % 2 = 0 then 'sh:' || h else h end").withColumn("p", text.split_language(F.col("c")))
    return df.select("k", "p.prefix", "p.rest")


@query("normalized_views", f"select k, case when k % 2 = 0 then 'a' || h || '|a' || chr(8203) || h || '&' else '' end as views from {KEYED}")
def _views(spark, sf_dir):
    df = _seeded(spark, sf_dir, "case when k % 2 = 0 then 'a​' || h || '&#38;' else 'plain ' || h end")
    first = F.transform(text.normalized_views(F.col("c")), lambda v: F.replace(v, F.lit("&#38;"), F.lit("")))
    return df.select("k", F.array_join(first, "|").alias("views"))


# Audit ------------------------------------------------------------------------------------------------------------

_ENTRY_SQL = """select user_id as log, row_number() over (partition by user_id order by event_id) as line_no, event_id,
  '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","tool":"' || event_type || '","action":"redacted"' || case when event_id % 2 = 0 then ',"rules":["a\\u003cb"],"count":1' else '' end || ',"prev":"' as head from events"""
_CHAIN_SQL = f"""e as ({_ENTRY_SQL}),
chain as (select log, line_no, event_id, head || '","hash":"' || sha256(head || '","hash":""}}') || '"}}' as line, sha256(head || '","hash":""}}') as hash from e where line_no = 1
  union all select e.log, e.line_no, e.event_id, head || c.hash || '","hash":"' || sha256(head || c.hash || '","hash":""}}') || '"}}', sha256(head || c.hash || '","hash":""}}')
  from chain c join e on e.log = c.log and e.line_no = c.line_no + 1)"""


def _chained(spark, sf_dir, raw: bool = False):
    e = _table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col("event_type").alias("tool"), F.lit("redacted").alias("action"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a<b"))).alias("rules"), F.when(F.col("event_id") % 2 == 0, 1).alias("count"), F.lit("").alias("field"),
    )
    return e if raw else audit.chain(e, "user_id", "event_id")


@query("audit_chain", f"with recursive {_CHAIN_SQL} select log, line_no, line from chain")
def _audit_chain(spark, sf_dir):
    return _chained(spark, sf_dir)


def _tampered(df):
    n = F.col("line_no")
    line = F.when(n % 17 == 5, F.regexp_replace("line", '"action":"redacted"', '"action":"passed"')).when(n % 17 == 9, F.lit('{"ts":"","tool":"t","action":"a"}')).when(n % 17 == 12, F.lit("not json")).otherwise(F.col("line"))
    return df.where(n % 17 != 3).withColumn("line", line)


_VERIFY_SQL = f"""with recursive {_CHAIN_SQL},
seen as (select *, line_no % 17 as m, lag(hash) over (partition by log order by line_no) as true_prev from chain),
kept as (select *, case when m in (9, 12) then '' else hash end as stored from seen where m <> 3),
before as (select *, coalesce(lag(stored) over (partition by log order by line_no), '') as expected from kept),
judged as (select log, line_no, case when m = 12 then 'parse' when m = 9 then 'legacy' when m = 5 then 'hash' when coalesce(true_prev, '') <> expected then 'chain' else 'ok' end as kind from before)"""


@query("audit_verify", f"{_VERIFY_SQL} select log, line_no, kind from judged")
def _audit_verify(spark, sf_dir):
    return audit.verify(_tampered(_chained(spark, sf_dir))).select("log", "line_no", "kind")


@query("audit_summary", f"{_VERIFY_SQL} select log, count(*)::bigint as total, (count(*) filter (kind = 'ok'))::bigint as verified, (count(*) filter (kind = 'legacy'))::bigint as legacy, (count(*) filter (kind in ('parse', 'hash', 'chain')))::bigint as broken, count(*) filter (kind in ('parse', 'hash', 'chain')) = 0 as ok from judged group by log")
def _audit_summary(spark, sf_dir):
    return audit.summary(audit.verify(_tampered(_chained(spark, sf_dir))))


_ONE_LOG_SQL = _VERIFY_SQL.replace("partition by log order by line_no), '') as expected", "order by log, line_no), '') as expected")


@query("audit_verify_one_log", f"{_ONE_LOG_SQL} select log * 100000 + line_no as line_no, kind from judged")
def _verify_one_log(spark, sf_dir):
    """All logs as one, in ranges of lines that carry the last hash over."""
    lines = _tampered(_chained(spark, sf_dir)).select(F.lit("all").alias("log"), (F.col("log") * 100_000 + F.col("line_no")).alias("line_no"), "line")
    return audit.verify(lines, 400_000).select("line_no", "kind")


_TYPED = {2: '{"ts":1,"hash":"x"}', 3: '{"ts":"","rules":"a","hash":"x"}', 4: '{"rules":[1],"hash":"x"}', 5: '{"count":1.5,"hash":"x"}', 6: '["a"]', 7: '{"ts":null,"rules":null,"count":null,"other":[{}]}'}


@query("audit_wrong_types", f"select log, line_no, case when line_no % 9 between 2 and 6 then 'parse' when line_no % 9 = 7 then 'legacy' when line_no % 9 = 8 then 'chain' else 'ok' end as kind from ({_ENTRY_SQL})")
def _wrong_types(spark, sf_dir):
    """A known field of a wrong type makes a line unreadable, not old; what follows has lost its chain."""
    n = F.col("line_no") % 9
    line = F.col("line")
    for k, text_ in _TYPED.items():
        line = F.when(n == k, F.lit(text_)).otherwise(line)
    return audit.verify(_chained(spark, sf_dir).withColumn("line", line)).select("log", "line_no", "kind")


@query("audit_many_writers", "select event_type as log, count(*) as total, count(*) as verified, 0 as broken, count(distinct event_id) as events from events group by all")
def _many_writers(spark, sf_dir):
    """Three writers append the events to the same logs at once; no entry is lost, and the chains hold."""
    from concurrent.futures import ThreadPoolExecutor

    from veilspark.operators import commits
    from veilspark.sources.shared import new_folder

    at = new_folder(spark)
    entries = _chained(spark, sf_dir, raw=True).withColumn("field", F.col("event_id").cast("string"))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: commits.append(spark, at, entries.where(F.col("event_id") % 3 == k), "tool", "event_id"), range(3)))
    lines = commits.lines(spark, at)
    seen = lines.select("log", F.get_json_object("line", "$.field").alias("event")).groupBy("log").agg(F.countDistinct("event").alias("events"))
    return audit.summary(audit.verify(lines)).select("log", "total", "verified", "broken").join(seen, "log")


@query("audit_last_hash", f"with recursive {_CHAIN_SQL} select log, arg_max(hash, line_no) as prev from chain group by log")
def _audit_last(spark, sf_dir):
    return audit.last_hash(_chained(spark, sf_dir))


# Streaming -----------------------------------------------------------------------------------------------------------


@query("stream_lines", _CORE_ORACLE)
def _stream(spark, sf_dir):
    """Seeded lines through a file stream, redacted line by line; what the sink got."""
    from veilspark.sources.shared import new_folder
    from veilspark.streaming.lines import redact_lines, run

    at = new_folder(spark)
    _seeded(spark, sf_dir, MIXED).select("k", "c").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("k long, c string").parquet(f"{at}/in")
    q = run(redact_lines(stream, MIXED_RULES, "c", deep=False), lambda batch, _: batch.write.mode("append").parquet(f"{at}/out"), f"{at}/state")
    q.awaitTermination()
    _dropped(spark, at)
    return spark.read.parquet(f"{at}/out").select(F.col("k").alias("o_orderkey"), "redacted", F.array_join("rules", ",").alias("rules"))


# an order is two lines of its customer's stream; a third of them break a key in two
_BROKEN = f"case when k % 3 = 0 then 'x ' || substr({_KEY}, 1, 8) when k % 3 = 1 then 'id ' || {_KEY} else 'no ' || h end"
_BROKEN_ON = f"case when k % 3 = 0 then substr({_KEY}, 9, 12) || ' y' else 'and on' end"
_BROKEN_DUCK = f"""d as (select o_custkey as stream, o_orderkey as k, md5(cast(o_orderkey as varchar)) as h from orders),
l as (select stream, 2 * k as seq, case when k % 3 = 0 then 'x ' || {_PH} when k % 3 = 1 then 'id ' || {_PH} else 'no ' || h end as redacted, k % 3 < 2 as hit from d
      union all select stream, 2 * k + 1, case when k % 3 = 0 then ' y' else 'and on' end, false from d)"""


@query("stream_keyed", f"with {_BROKEN_DUCK} select stream, seq, redacted, case when row_number() over (partition by stream order by seq desc) = 1 and bool_or(hit) over (partition by stream) then '[veilspark] redacted 1 secret(s) (aws-access-key)' end as hint from l")
def _stream_keyed(spark, sf_dir):
    """Lines of many streams that come in three parts, cut between the halves of a key; the last part after a restart."""
    from veilspark.sources.shared import arrived, new_folder
    from veilspark.streaming.keyed import redact_streams

    at = new_folder(spark)
    pairs = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream"), F.col("o_orderkey").alias("k"))
    most = 2 * (pairs.agg(F.max("k")).first()[0] or 0) + 1
    third = (most // 3) | 1  # odd: the second line of a pair begins a batch
    pairs = pairs.withColumn("newest", F.max("k").over(Window.partitionBy("stream"))).withColumn("h", F.md5(F.col("k").cast("string")))
    both = F.expr(f"array(struct(2 * k as seq, {_BROKEN} as line, false as last), struct(2 * k + 1 as seq, {_BROKEN_ON} as line, k = newest as last))")
    lines = pairs.select("stream", F.explode(both).alias("l")).select("stream", "l.*", F.least(F.floor(F.col("l.seq") / third), F.lit(2)).cast("int").alias("part"))
    lines.write.partitionBy("part").parquet(f"{at}/all")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for parts in ((0, 1), (2,)):
            for n in parts:
                arrived(spark, f"{at}/all/part={n}", f"{at}/in/part={n}")
            stream = spark.readStream.schema("stream long, seq long, line string, last boolean, part int").option("maxFilesPerTrigger", 100_000).parquet(f"{at}/in")
            done = redact_streams(stream.drop("part"), [RULES["aws-access-key"]])
            done.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    _dropped(spark, at)
    drop_folder(spark, f"{at}/all")
    return spark.read.parquet(f"{at}/out").select("stream", "seq", "redacted", "hint")


from veilspark.plans import routes  # noqa: E402, F401  registers its queries
