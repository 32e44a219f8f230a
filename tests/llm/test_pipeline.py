"""The pipeline's stages, each on what its predecessor kept, against plain versions; classifier and near-duplicates as queries too."""

import collections
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import html, quality, records, simhash
from veilspark.llm.oracles import OP6

SF = "/root/testdata/sf0.001"
PIPELINE = os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")


def _rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def _fingerprint(text, n=4):
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def _components(rows):
    """The smallest doc_id of each row's component, by all pairs."""
    prints = [_fingerprint(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                at[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return prints, [least[find(i)] for i in range(len(rows))]


def _graded(docs, labels):
    """doc_id to expected grade and tail, by the formula, from the model of all labelled rows that aren't held out."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    texts = dict(docs)
    known = sorted((r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None and not held(r["doc_id"]) and r["doc_id"] in texts)
    m = quality.fit(np.array([quality.features(texts[i].encode()) for i, _ in known]), np.array([y for _, y in known]))
    out = {}
    for i, t in docs:
        x = quality.features(t.encode()).astype(np.float64)
        over = [1 / (1 + np.exp(-(x @ m.weights - k))) for k in m.thresholds]
        out[i] = (m.grades[0] + sum(p * (b - a) for p, a, b in zip(over, m.grades, m.grades[1:])), over[-1])
    return out


def test_grades(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = _graded(_rows(docs), labels)
    for r in quality.report(docs, labels).collect():
        assert (r["expected_grade"], r["tail_probability"]) == pytest.approx(want[r["doc_id"]], abs=1e-3)
        assert r["kept"] == (want[r["doc_id"]][1] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = _rows(docs)
    prints, least = _components(rows)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.report(docs).collect()}
    assert got == {i: (f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, least)}
    assert len(set(least)) < len(rows)


@pytest.mark.skipif(not os.path.exists(PIPELINE), reason="the pipeline was removed")
def test_stages(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, inputs[-1], SF).write.parquet(f"{tmp_path}/{n}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{n}"))
    given, graded, distinct, clean, mixed = map(_rows, inputs)
    # 1: the classifier
    grades = _graded(given, labels)
    assert sorted(graded) == sorted((i, t) for i, t in given if grades[i][1] >= 0.5) and 0 < len(graded) < len(given)
    # 2: one document of each component
    _, least = _components(graded)
    assert sorted(distinct) == sorted((i, t) for (i, t), c in zip(graded, least) if i == c)
    # 3: no document with a benchmark window
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    runs = [words(r["text"] or "") for r in bench.collect()]
    windows = {tuple(w[i : i + 10]) for w in runs if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))
    assert sorted(clean) == sorted((i, t) for i, t in distinct if not hit(t)) and len(clean) < len(distinct)
    # 4: as many words of each document as SQL has it take, in their order
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/2/*.parquet'")
    taken = {r[0]: r[1] for r in con.execute(f"select doc_id, taken from ({OP6})").fetchall() if r[1]}
    got = collections.Counter()
    whole = {i: t.encode().split() for i, t in clean}
    for i, t in mixed:
        got[i] += len(t.encode().split())
        rest = iter(whole[i])
        assert all(w in rest for w in t.encode().split())  # `in` goes on from where it was
    assert got == collections.Counter(taken)
    # 5: the ids of the tokenizers library, and the whole run
    t = Tokenizer.from_file(records.default_vocabulary())
    start, want = 0, []
    for i, text in sorted(mixed):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, inputs[-1], SF)
    assert sorted(tuple(r) for r in last.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_odd_pages(spark):
    """Columns of any names, a page of megabytes, reruns."""
    body = "".join(f"<p>Paragraph {k} of a long page.</p>" for k in range(60_000))
    rows = [(k, f"http://h/{k}", f"<article><p>Story {k}</p><p>Same for all</p></article>", "x", 1, "y", None) for k in range(20)] + [(99, "http://h/99", f"<article>{body}</article>", "x", 1, "y", None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, hash long, text string, hashes array<long>").repartition(3)
    one, two = (sorted(map(str, html.report(df).collect())) for _ in range(2))
    assert one == two and len(one) == 22
    by = {r["page_id"]: r["text"] for r in html.report(df).where(F.col("page_id").isNotNull()).collect()}
    assert by[3] == "Story 3" and by[99].count("\n") == 59_999
    assert html.report(df.where("false")).count() == 0
