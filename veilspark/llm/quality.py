"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - theta_k), with one weight vector w for all grades and
ordered thresholds theta. x is hashed text: counts of byte trigrams in DIMS hashed
places, at unit length, and one hashed token each for the text's bucketed shares of
distinct words, capitals, symbols and digits and for its bucketed length of words. The
model gives a document's expected grade and its tail probability of reaching `keep_grade`,
by which it's selected.

It's fitted on at most `max_rows` labelled rows (those whose doc_id hashes lowest), with
rows of crc32(doc_id) mod 5 = 0 held out; everything else covers all documents. The
driver gets the sampled rows' hashed counts, DIMS numbers each at most.

Defined results: null and empty texts are scored like any other, by the thresholds and
the tokens of an empty text. Labels that are null or whose document is missing are left out. Without
labels, or with one grade alone, all documents are kept (expected_grade is that grade, or
null). Repeated rows give repeated result rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, as_list

DIMS, SHAPE_DIMS, MAX_ROWS = 4096, 64, 4000
_CAPS, _SYMBOLS, _DIGITS = re.compile(rb"[A-Z]"), re.compile(rb"[#*$%&|<>{}\[\]^~_=+\\]"), re.compile(rb"[0-9]")


def _shares(text: bytes) -> list[int]:
    """Place of the text's bucket for each of 5 measures, 10 buckets each."""
    words, n = text.split(), max(1, len(text))
    share = (
        len(set(words)) / max(1, len(words)),
        len(_CAPS.findall(text)) / n * 2,
        len(_SYMBOLS.findall(text)) / n * 4,
        len(_DIGITS.findall(text)) / n * 4,
        np.log2(1 + len(words)) / 16,
    )
    return [10 * k + min(9, int(10 * s)) for k, s in enumerate(share)]


def features(text: bytes | None) -> np.ndarray:
    text = text or b""
    x = np.zeros(DIMS + SHAPE_DIMS, np.float32)
    if len(text) > 2:
        a = np.frombuffer(text, np.uint8).astype(np.uint32)
        h = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        c = np.bincount(h, minlength=DIMS)
        x[:DIMS] = c / np.sqrt((c.astype(np.float64) ** 2).sum())
    x[[DIMS + k for k in _shares(text)]] = 0.5
    return x


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def over(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k; x: rows of features."""
        z = (x @ self.weights)[:, None] - self.thresholds[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def expected(self, over: np.ndarray) -> np.ndarray:
        return self.grades[0] + over @ np.diff(np.array(self.grades, np.float64))

    def tail(self, over: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= grade)."""
        k = int(np.searchsorted(self.grades, grade))
        return np.ones(len(over)) if k == 0 else np.zeros(len(over)) if k == len(self.grades) else over[:, k - 1]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> Model:
    """Minimises the mean negative log likelihood plus penalty |w|^2 by L-BFGS. The first threshold is free, the gaps between thresholds are exponentials, so they stay ordered."""
    grades = sorted(set(y.tolist()))
    level = np.searchsorted(grades, y)
    n, d, k = *x.shape, len(grades) - 1
    if k < 1:
        return Model(grades, np.zeros(d), np.zeros(0))

    def parts(p):
        return p[:d], np.concatenate(([p[d]], p[d] + np.cumsum(np.exp(p[d + 1 :]))))

    def loss(p):
        w, theta = parts(p)
        z = x @ w.astype(np.float32)
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None, :], -40, 40)))
        upper = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), axis=1)  # P(level >= j)
        rows = np.arange(n)
        a, b = upper[rows, level], upper[rows, level + 1]
        like = np.maximum(a - b, 1e-12)
        ga, gb = a * (1 - a) / like, b * (1 - b) / like  # slopes of log likelihood by z
        gz = -(ga - gb) / n
        gt = np.zeros(k)
        np.add.at(gt, level[level > 0] - 1, ga[level > 0] / n)
        np.add.at(gt, level[level < k], -gb[level < k] / n)
        gp = np.empty_like(p)
        gp[:d] = x.T @ gz.astype(np.float32) + 2 * penalty * w
        gp[d] = gt.sum()
        tails = np.cumsum(gt[::-1])[::-1]
        gp[d + 1 :] = tails[1:] * np.exp(p[d + 1 :])
        return -np.log(like).mean() + penalty * (w @ w), gp

    p = np.zeros(d + k)
    share = np.clip([(level > j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    p[d], p[d + 1 :] = first[0], np.log(np.maximum(np.diff(first), 1e-3))
    f, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, held = g.copy(), []
        for s, t in reversed(past):
            a = (s @ q) / (s @ t)
            held.append(a)
            q -= a * t
        if past:
            s, t = past[-1]
            q *= (s @ t) / (t @ t)
        for (s, t), a in zip(past, reversed(held)):
            q += (a - (t @ q) / (s @ t)) * s
        step, slope = 1.0 if past else min(1.0, 1 / (np.abs(g).sum() + 1e-12)) * 10, g @ q
        if slope <= 1e-14:
            break
        while step > 1e-8:
            f2, g2 = loss(p - step * q)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = -step * q, g2 - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t)]
        done = f - f2 < 1e-7
        p, f, g = p + s, f2, g2
        if done:
            break
    w, theta = parts(p)
    return Model(grades, w, theta)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", max_rows: int = MAX_ROWS) -> Model | None:
    rated = labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rated = rated.select(F.col("doc_id").alias("_rated"), F.col(grade).cast("int").alias("_grade")).orderBy(F.xxhash64("_rated"), "_rated", "_grade").limit(max_rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rated), F.col("doc_id") == F.col("_rated")).select("doc_id", "_grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in as_bytes(batch, "text")]
            at = [np.flatnonzero(r).astype(np.uint16) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(rows, at)], pa.binary())], names=["doc_id", "grade", "at", "x"]
            )

    rows = sorted(sample.mapInArrow(run, "doc_id long, grade int, at binary, x binary").collect(), key=lambda r: (r["doc_id"], r["grade"], bytes(r["x"])))
    if not rows:
        return None
    x = np.zeros((len(rows), DIMS + SHAPE_DIMS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    return fit(x, np.array([r["grade"] for r in rows]))


def score(docs: DataFrame, model: Model | None, keep_grade: int | None = None, least: float = 0.5, name: str = "_quality") -> DataFrame:
    """docs with all their columns and, last, a struct of expected, tail and kept."""
    if model is None or len(model.grades) < 2:
        only = F.lit(None if model is None else float(model.grades[0])).cast("double")
        return docs.select("*", F.struct(only.alias("expected"), F.lit(1.0).alias("tail"), F.lit(True).alias("kept")).alias(name))
    goal = model.grades[-1] if keep_grade is None else keep_grade

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            over = np.concatenate([np.zeros((0, len(model.thresholds)))] + [model.over(features(t)[None, :]) for t in texts.cast(pa.binary()).to_pylist()])
            tail = model.tail(over, goal)
            yield pa.StructArray.from_arrays([pa.array(model.expected(over)), pa.array(tail), pa.array(tail >= least)], names=["expected", "tail", "kept"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.select("*", F.arrow_udf(run, "expected double, tail double, kept boolean")(F.col("text").cast("string")).alias(name))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, kept; a row for each row of docs."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    q = F.col("_quality")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), q["expected"].alias("expected_grade"), q["tail"].alias("tail_probability"), q["kept"].alias("kept"))


def select(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """docs with all their columns, less those rejected."""
    name = "_quality" + "_" * max((len(c) for c in docs.columns), default=0)  # none of docs' own
    return score(docs, train(docs, labels), **settings, name=name).where(F.col(name)["kept"]).select(*docs.columns)
