"""Periodic runs, vector codes and repeated lines against plain versions of themselves."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from veilspark.llm import line_dedup, periodic, vector_codes

SF = "/root/testdata/sf0.001"


# 11 ----------------------------------------------------------------------------------------


def plain_runs(w):
    """(start, length, period), by trying every start and period."""
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)  # periods ascend, so the smallest one stays
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def plain_periodic(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a, n = g % len(w), len(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    exponent = 1000 * best[1] // best[2] if found else None
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in sorted(found, key=lambda r: (r[0], r[2])))
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_words():
    rng = random.Random(1)
    texts = []
    for n in [0, 1, 5, 6, 7, 24, 60, 150, 400] * 6:
        w = [rng.randrange(rng.choice((1, 2, 3, 30))) for _ in range(n)]
        for _ in range(rng.randrange(4)):  # with runs in it
            a, q, k = rng.randrange(n + 1), rng.randrange(1, 9), rng.randrange(4, 9)
            w[a : a + q * k] = (w[a : a + q] * k)[: len(w) - a] if w[a : a + q] else []
        texts.append(w)
    ids = np.array([x for w in texts for x in w], np.int64)
    got = defaultdict(list)
    for o, a, n, p in zip(*(x.tolist() for x in periodic.runs(ids, np.array([len(w) for w in texts])))):
        got[o].append((a, n, p))
    for k, w in enumerate(texts):
        assert sorted(got[k]) == plain_runs(w), (k, w)


def test_runs_hold_beyond_the_group_and_with_bad_hashes(monkeypatch):
    """Few pairs at a time, and hashes that say that all words agree."""
    rng = random.Random(2)
    w = [rng.randrange(2) for _ in range(300)] + [7, 8, 9] * 20 + [1] * 50
    monkeypatch.setattr(periodic, "PAIRS", 17)
    ids, n = np.array(w * 2, np.int64), np.array([len(w), len(w)])
    twice = [tuple(r) for r in zip(*(x.tolist() for x in periodic.runs(ids, n)))]
    assert [r[1:] for r in twice if r[0] == 0] == [r[1:] for r in twice if r[0] == 1] == sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    monkeypatch.setattr(periodic, "PAIRS", 1 << 21)
    monkeypatch.setattr(periodic, "_prefixes", lambda ids: (np.zeros(len(ids) + 1, np.uint64), np.ones(len(ids) + 1, np.uint64)))
    assert [tuple(r) for r in zip(*(x.tolist() for x in periodic.runs(ids[: len(w)], n[:1])))] == [r for r in twice if r[0] == 0]


def test_periodic_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"] if len(r["text"] or "") < 6000 else r["text"][:6000]) for r in d]
    rows += [(None, "a a a a a a a a"), (None, None), (5, " \n"), (7, "x y " * 30), (7, "x y " * 30), (8, "é é " * 9)]
    got = periodic.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_periodic(*r)) for r in rows)


def test_collapsed_text(spark):
    r = periodic.detect(spark.createDataFrame([(1, "one  two la la la la la la la end")], "doc_id long, text string")).first()
    assert r["collapsed"] == "one two la end" and [tuple(x) for x in r["runs"]] == [(2, 7, 1)] and r["exponent_milli"] == 7000


# 12 ----------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    """rows: (vec_id, label, integers). Codes, errors and codebooks by trying every entry, in Python's integers."""
    width = len(rows[0][2]) // parts
    cut = [[r[2][k * width : (k + 1) * width] for k in range(parts)] for r in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))[:entries]
    books = [[cut[i][k] for i in first] for k in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(book))

    for step in range(rounds + 1):
        found = [[near(c[k], books[k]) for k in range(parts)] for c in cut]
        if step == rounds:
            return [[n for _, n in f] for f in found], [sum(d for d, _ in f) for f in found], books
        for k in range(parts):
            for e in range(len(books[k])):
                own = [cut[i][k] for i in range(len(rows)) if found[i][k][1] == e]
                if own:
                    books[k][e] = [sum(x) // len(own) for x in zip(*own)]


def plain_report(rows, parts=16, entries=64, rounds=2):
    codes, errors, books = plain_codes(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = defaultdict(int)
    for r, e in zip(rows, errors):
        by[r[1]] += e
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(repr((r[0], "".join(f"{c:02x}" for c in code), fits(e), fits(by[r[1]]), digest)) for r, code, e in zip(rows, codes, errors))


def whole(v):
    return [int(np.floor(x * 256)) for x in np.array(v, np.float32).astype(np.float64)]


def test_nearest_is_exact():
    rng = np.random.default_rng(4)
    for size, spread, kind in ((64, 40, np.int64), (64, 2, np.int64), (9, 3, np.int64), (3, 5, np.int64), (1, 5, np.int64), (33, 4, object)):
        book = rng.integers(-spread, spread, (size, 4)).astype(kind) * (10**25 if kind is object else 1)
        points = rng.integers(-spread, spread, (300, 4)).astype(kind) * (10**25 if kind is object else 1)
        index, best = vector_codes.nearest(points, book, vector_codes.tree(book))
        far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert index.tolist() == far.argmin(axis=1).tolist() and best.tolist() == far.min(axis=1).tolist()


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6, 3e37])
def test_codes_against_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(150, 32)) * scale).astype(np.float32)
    v[70:90] = v[:20]  # ties
    rows = [(k if k != 140 else None, int(k % 3) if k % 7 else None, [float(x) for x in v[k]]) for k in range(150)]
    rows.append(rows[4])
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    plain = plain_report([(i, c, whole(x)) for i, c, x in rows])
    assert sorted(repr(tuple(r)) for r in vector_codes.report(df).collect()) == plain
    assert sorted(repr(tuple(r)) for r in vector_codes.report(df.repartition(3), broadcast_labels=0).collect()) == plain


def test_odd_vectors(spark):
    bad = [(1, 1, None), (2, 1, [1.0, None] * 8), (3, 1, [float("nan")] * 16), (4, 1, [float("inf")] * 16), (5, 1, []), (6, 1, [0.5] * 15), (0, None, [float("-inf")] + [0.0] * 15)]
    kind = "vec_id long, label int, embedding array<float>, code string, part int, error long"
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in bad], kind)
    assert vector_codes.report(df).count() == 0 and vector_codes.report(df.where("false")).count() == 0
    good = [(9, 1, [0.1 * k for k in range(16)]), (9, 1, [0.1 * k for k in range(16)]), (8, None, [-0.3] * 16), (10, 1, [2.0] * 16)]
    longer = (11, 2, [1.0] * 32)  # not as long as the row of least vec_id
    got = vector_codes.report(spark.createDataFrame([(*r, "c", 1, 2) for r in [*bad, *good, longer]], kind))
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_report([(i, c, whole(x)) for i, c, x in good])


def test_errors_beyond_64_bits_are_null(spark):
    rows = [(k, 0 if k < 70 else 1, [float(k) * 1e30] * 16) for k in range(80)]
    got = {r["vec_id"]: r for r in vector_codes.report(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    codes, errors, _ = plain_codes([(i, c, whole(x)) for i, c, x in rows], 16, 64, 2)
    assert any(e >= 1 << 63 for e in errors)
    assert all(got[i]["error"] == (e if e < 1 << 63 else None) for i, e in enumerate(errors))
    assert {got[i]["label_error"] for i, e in enumerate(errors) if e >= 1 << 63} == {None}


# 13 ----------------------------------------------------------------------------------------


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for k, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            holders[key(line)].add(k)
    last = {}
    for x, own in holders.items():
        if len(x) >= min_chars and len(own) >= min_docs:
            ids = [rows[k][0] for k in own if rows[k][0] is not None]
            last[x] = max(ids) if ids else None
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x)) is None or last[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = random.Random(6)
    common = [f"  Shared LINE number {k} with café and enough letters to count\t" for k in range(12)] + ["short shared line", "x" * 39, "y" * 40]
    rows = []
    for k in range(120):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own line {k} {rng.random()} " + "z" * 40 for _ in range(rng.randrange(1, 9))]
        rows.append((k, "\n".join(x.upper() if rng.random() < 0.3 else x for x in lines)))
    nulls = [(None, "only rows without an id hold this line of many letters")] * 6
    return [*rows, *nulls, (3, None), (4, ""), (5, "\n\n"), (200, common[0]), (200, common[0]), (None, common[1]), (6, "w" * 300_000 + "\n" + common[2])]


@pytest.mark.parametrize("bits, keys", [(None, 200_000), (1 << 20, -1), (1 << 18, 200_000)])
def test_lines_against_brute_force(spark, bits, keys):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(repr((i, n, d, hashlib.sha256(t.encode()).hexdigest())) for i, n, d, t in plain_lines(rows))
    assert sorted(repr(tuple(r)) for r in line_dedup.report(df, bits=bits, broadcast_keys=keys).collect()) == want


def test_lines_leave_the_text(spark):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, row string, n_lines int")
    out = line_dedup.deduplicate(df)
    assert out.schema == df.schema
    assert sorted(repr(tuple(r)) for r in out.collect()) == sorted(repr((i, t, "q", 1)) for i, _, _, t in plain_lines(rows))


def test_filters_never_miss():
    rng = np.random.default_rng(7)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    f = line_dedup.Filters(1 << 16)
    f.add(np.zeros(5000, np.int64), np.concatenate((h[:4000], h[:1000])))  # twice in one document is once
    assert line_dedup.suspects(h[:1000], f.twice).mean() < 0.9
    f.add(np.arange(2000), h[:2000])
    assert line_dedup.suspects(h[:2000], f.twice).all()
