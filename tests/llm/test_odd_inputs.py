"""Every operator and stage on null, empty, repeated, very long and empty-table inputs."""

import hashlib
import os
from collections import Counter

import pytest

from veilspark.llm import automaton, decontaminate, html, line_dedup, mixing, periodic, perplexity, quality, records, simhash, suffix_array, toxicity

REPORTS = {
    "decontaminate": lambda d, b, l: decontaminate.report(d, b),
    "quality": lambda d, b, l: quality.report(d, l),
    "records": lambda d, b, l: records.write_and_read(d),
    "suffix_array": lambda d, b, l: suffix_array.report(d),
    "toxicity": lambda d, b, l: toxicity.report(d, l),
    "mixing": lambda d, b, l: mixing.report(d),
    "simhash": lambda d, b, l: simhash.report(d),
    "perplexity": lambda d, b, l: perplexity.report(d),
    "automaton": lambda d, b, l: automaton.report(d),
    "periodic": lambda d, b, l: periodic.report(d),
    "line_dedup": lambda d, b, l: line_dedup.report(d),
    "line_dedup joined": lambda d, b, l: line_dedup.report(d, bits=1 << 20, broadcast_keys=-1),
}


@pytest.mark.parametrize("name", REPORTS)
def test_a_row_for_each_row(name, odd, benchmark, labels):
    ids = Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert Counter(r["doc_id"] for r in REPORTS[name](odd, benchmark, labels).collect()) == ids


@pytest.mark.parametrize("name", REPORTS)
def test_empty_tables(name, none, odd, benchmark, labels):
    assert REPORTS[name](none, benchmark, labels).count() == 0
    assert REPORTS[name](none, benchmark.where("false"), labels.where("false")).count() == 0
    assert REPORTS[name](odd, benchmark.where("false"), labels.where("false")).count() == odd.count()


@pytest.mark.parametrize("name", REPORTS)
def test_reruns_agree(name, odd, benchmark, labels):
    once, again = (sorted(map(str, REPORTS[name](odd, benchmark, labels).collect())) for _ in range(2))
    assert once == again


def test_null_texts(odd, benchmark, labels):
    empty = hashlib.sha256(b"").hexdigest()
    r = {x["doc_id"]: x for x in decontaminate.report(odd, benchmark).where("doc_id is not null").collect()}
    assert (r[1]["n_words"], r[1]["n_hit"], r[1]["items_sha256"], r[1]["contaminated"]) == (0, 0, empty, False)
    # an item of one window, and the item without id, which isn't counted
    assert r[10]["n_hit"] == 11 and r[10]["n_items"] == 2
    assert r[6]["contaminated"] and r[6]["n_items"] == 0
    s = {x["doc_id"]: x for x in suffix_array.report(odd).where("doc_id is not null").collect()}
    assert (s[1]["n_bytes"], s[1]["kept_sha256"]) == (0, empty)
    assert s[5]["n_removed"] == s[5]["n_bytes"]  # it repeats in itself
    w = {x["doc_id"]: x for x in automaton.report(odd).where("doc_id is not null").collect()}
    assert w[5]["n_removed"] == 0  # but no smaller document has it
    m = {x["doc_id"]: x for x in simhash.report(odd).where("doc_id is not null").collect()}
    assert m[1]["fingerprint"] == "0" * 16 and m[2]["component_id"] == 1


PIPELINE = os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")


@pytest.mark.skipif(not os.path.exists(PIPELINE), reason="the pipeline was removed")
def test_stages_keep_columns(spark, odd, none, benchmark, labels, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    benchmark.write.parquet(f"{sf}/benchmark.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == odd.count()


def test_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "nonsense", ""), (2, "http://h.example/a", "<p>one<p>two &amp; three"), (3, "http://h.example/b", "<" * 1000), (4, "http://h.example/c", "<div>" * 3000 + "deep")]
    out = sorted((tuple(r) for r in html.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    by = {r[0]: r for r in out}
    assert len(out) == 6 and by[1][2] == "" and by[2][2] == "one\ntwo & three" and by[4][2] == "deep"
    assert html.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
