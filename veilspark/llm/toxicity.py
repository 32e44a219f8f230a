"""Toxicity by a support vector machine on a subsequence string kernel with Nystrom landmarks.

The kernel of two words sums over subsequences of 3 and 4 characters that occur in both,
gaps allowed, each weighed by DECAY for every character that its occurrence spans; word
ends count as characters. Occurrences may leave out at most two characters, so a word's
subsequences can be listed, and an inserted or doubled character leaves most of them.
The kernel is scaled by the words' own sums of squares. Landmark words give the Nystrom
map K^(-1/2) k(x); a linear machine on it is one weight for each (hashed) subsequence, so
any word is scored by looking its subsequences up.

Labels are on documents, so the labelled texts' words are learnt from as bags: words
that toxic documents hold far more often than others start as positives, weighed by how
telling they are, the most telling with every one-letter insertion; words of documents
without the label are negatives. In each round the machine's errors on clean documents become
negatives and the best words of toxic documents it missed become positives. A document's
score comes from its TOP most toxic distinct words, through a logistic curve fitted on the
training documents and on toxic ones with their insults altered: one strong insult or
several weak ones are toxic, one word that merely resembles an insult isn't. White space between
single characters, and characters other than letters inside a word, are taken out first.

It's fitted on at most `max_rows` labelled rows for each label (those whose doc_id hashes
lowest) with crc32(doc_id) mod 5 other than 0; scoring covers all documents, whole texts.
Only texts are inputs.

Defined results: null and empty texts, and texts without a letter, have the lowest score
that the curve gives. Null labels are left out; without both labels every score is 0. A null
doc_id isn't held out. Repeated rows give repeated result rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, as_list
from veilspark.llm.quality import held_out

MAX_ROWS, LANDMARKS, ROUNDS = 2500, 400, 2
#: Insults of which all one-letter insertions are positives, and what these weigh together beside the word itself.
VARIED, VARIED_WEIGHT = 15, 0.5
#: What a toxic document with its insults altered weighs in the curve.
ALTERED_WEIGHT = 0.1
PLACES, DECAY, LONGEST = 1 << 16, 0.8, 24
#: Words that are mapped, rows that are multiplied and documents that are looked up together.
BLOCK = 2000
#: Offsets of a subsequence's further characters.
SUBSEQUENCES = [(1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4), (1, 3, 5), (2, 3, 5), (2, 4, 5)]
CACHE_WORDS = 400_000
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_OTHER = re.compile(r"[\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct words as they stand, lower case, and runs of single characters joined."""
    low = text.lower()
    out = set(low.split())
    out.update(_OTHER.sub("", m) for m in _SPACED.findall(low))
    return out


def letters(word: str) -> list[str]:
    """A word's pieces to score: its letters; more than one only if it's long."""
    if not word.isalpha():
        word = _OTHER.sub("", word)
    if len(word) <= LONGEST:
        return [word] if len(word) > 2 else []
    return [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of "^word$" as 16-bit numbers in rows of equal width, and their lengths."""
    n = np.array([len(w) + 2 for w in words])
    wide = int(n.max(initial=3))
    text = "".join(("^" + w + "$").ljust(wide, "\0") for w in words)
    return np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(words), wide), n


def _occurrences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each kind of subsequence: places (words x starts), which are in the word, weight."""
    c, n = _matrix(words)
    for kind, more in enumerate(SUBSEQUENCES):
        wide = c.shape[1] - more[-1]
        if wide < 1:
            continue
        h = c[:, :wide] * np.uint32(0x9E3779B1)
        for k in more:
            h = ((h ^ (h >> np.uint32(15))) + c[:, k : k + wide]) * np.uint32(0x85EBCA77)
        # equal subsequences meet whatever their gaps, those of 3 and 4 characters never by design
        h = ((h ^ (h >> np.uint32(13)) ^ np.uint32(len(more) * 0x5BD1)) * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
        yield h, np.arange(wide)[None, :] + more[-1] < n[:, None], DECAY ** (more[-1] + 1)


def _norms(n: np.ndarray) -> np.ndarray:
    own = np.zeros(len(n))
    for more in SUBSEQUENCES:
        own += np.maximum(n - more[-1], 0) * DECAY ** (2 * more[-1] + 2)
    return np.sqrt(np.maximum(own, 1e-9))


def landmark_weights(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places that words' subsequences have, and the words' scaled weights at these, a row each: most of PLACES has none."""
    found = [(np.nonzero(inside)[0], h[inside].astype(np.int64), weight) for h, inside, weight in _occurrences(words)]
    places = np.unique(np.concatenate([h for _, h, _ in found])) if found else np.zeros(0, np.int64)
    out = np.zeros((len(words), len(places)), np.float32)
    for row, h, weight in found:
        at, n = np.unique(row * len(places) + np.searchsorted(places, h), return_counts=True)
        out.reshape(-1)[at] += weight * n
    out /= _norms(np.array([len(w) + 2 for w in words]))[:, None].astype(np.float32)
    return places, out


def mapped(words: list[str]) -> np.ndarray:
    """Words' scaled subsequence weights, a row of PLACES each."""
    places, own = landmark_weights(words)
    out = np.zeros((len(words), PLACES), np.float32)
    out[:, places] = own
    return out


def dot(words: list[str], weights: np.ndarray, rows: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """Scaled subsequence weights of words times weights: of PLACES, or PLACES x m; or of fewer rows, if `rows` has a row's number for each place. Into out, if given."""
    if out is None:
        out = np.zeros((len(words), *weights.shape[1:]))
    for at in range(0, len(words), BLOCK):
        some, sums = words[at : at + BLOCK], out[at : at + BLOCK]
        for h, inside, weight in _occurrences(some):
            for k in range(h.shape[1]):
                got = weights[h[:, k] if rows is None else rows[h[:, k]]]
                got[~inside[:, k]] = 0
                got *= weight
                sums += got
        norms = _norms(np.array([len(w) + 2 for w in some]))
        sums /= norms[:, None] if out.ndim == 2 else norms
    return out


def machine(x1: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, each class' weights w scaled to a half; by accelerated gradient. The last column of x1 is ones."""
    up, down = w[y > 0].sum(), w[y <= 0].sum()
    w = w * np.where(y > 0, 0.5 / up if up else 0, 0.5 / down if down else 0)
    square = np.zeros((x1.shape[1], x1.shape[1]))
    for at in range(0, len(x1), BLOCK):
        some = x1[at : at + BLOCK]
        square += (some * w[at : at + BLOCK, None]).T @ some
    bound = 2 * np.linalg.norm(square, 2) + 2 * penalty
    p = q = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x1 @ q))
        g = -2 * x1.T @ (w * y * gap)
        g[:-1] += 2 * penalty * q[:-1]
        new, t2 = q - g / bound, (1 + np.sqrt(1 + 4 * t * t)) / 2
        q, p, t = new + (t - 1) / t2 * (new - p), new, t2
    return p[:-1], float(p[-1])


FLOOR, TOP = -2.0, 3


def evidence(tops: np.ndarray) -> np.ndarray:
    """What the curve sees of a document's TOP most toxic distinct words, best first: the best as it is and beyond the margin, the others as far as they're on the toxic side."""
    return np.concatenate((tops[:, :1], np.maximum(tops[:, :1] - 1, 0), np.maximum(tops[:, 1:], 0)), axis=1)


@dataclass
class Model:
    weights: np.ndarray  # of each place
    bias: float
    curve: np.ndarray  # of evidence(), and a constant

    def word_scores(self, words: list[str]) -> np.ndarray:
        return dot(words, self.weights) + self.bias if words else np.zeros(0)

    def probability(self, best) -> np.ndarray:
        """Of documents by the scores of their most toxic words: TOP each, or the best alone."""
        tops = np.full((np.size(best) if np.ndim(best) < 2 else len(best), TOP), FLOOR)
        if np.ndim(best) < 2:
            tops[:, 0] = best
        else:
            tops[:] = best
        z = evidence(np.maximum(tops, FLOOR)) @ self.curve[:-1] + self.curve[-1]
        out = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out if np.ndim(best) else out[0]


def _order(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 11)


def inserted(word: str) -> list[str]:
    """A word with each letter put in at each place inside it, its own included."""
    if len(word) < 4:
        return []
    return list(dict.fromkeys(word[:k] + c + word[k:] for k in range(1, len(word)) for c in sorted(set("abcdefghijklmnopqrstuvwxyz") | set(word))))


def altered(word: str) -> str:
    """A word with one letter put in, always the same."""
    every = inserted(word)
    return every[_order(word) % len(every)] if every else word


def distinct_bags(bags: list[tuple[set[str], int]]) -> list[tuple[set[str], int]]:
    """bags less copies and near copies, whose words would all look typical of their label: those that share two of four pairs of minimum hashes with an earlier one."""
    seen: set[tuple] = set()
    out = []
    for b, y in bags:
        if len(b) < 8:
            out.append((b, y))
            continue
        h = np.fromiter((_order(w) & 0xFFFFFFFF for w in b), np.uint64, len(b))
        least = [int(((h * np.uint64(2 * k + 0x9E3779B1) + np.uint64(k * 0x85EBCA77)) & np.uint64(0xFFFFFFFF)).min()) for k in range(8)]
        keys = [(k, least[2 * k], least[2 * k + 1]) for k in range(4)]
        if sum(k in seen for k in keys) < 2:
            out.append((b, y))
        seen.update(keys)
    return out


def bags_of(rows: Iterable[tuple[str, int]]) -> list[tuple[set[str], int]]:
    """Bags of texts of words parted by spaces, and their labels. A word of several bags is held once."""
    once: dict[str, str] = {}
    return [({once.setdefault(w, w) for w in text.split(" ") if w}, y) for text, y in rows]


def fit(bags: list[tuple[set[str], int]], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model | None:
    """bags: letters of a document's words, and its label."""
    own_bags = distinct_bags(bags)
    toxic = [b for b, y in own_bags if y == 1]
    clean = [b for b, y in own_bags if y == 0]
    if not toxic or not clean:
        return None
    pos, neg = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    base = len(toxic) / len(own_bags)

    def surprise(w: str) -> float:
        """G statistic of a word's share of toxic documents against the share of all; 0 if it's no larger."""
        n, m = pos[w], neg[w]
        if n / (n + m) <= base:
            return 0.0
        return 2 * (n * np.log(n / (n + m) / base) + (m * np.log(m / (n + m) / (1 - base)) if m else 0))

    told = {w: surprise(w) for w in pos}
    # beyond what the largest of so many words would reach by chance
    clear = [w for w, g in told.items() if g > 2 * np.log(len(told) / 0.05) and pos[w] / len(toxic) > 20 * neg[w] / len(clean)]
    first = sorted(clear, key=lambda w: (-told[w], _order(w)))[:400] or sorted(pos, key=lambda w: (-told[w], _order(w)))[:20]
    seeds = {w: np.sqrt(max(told[w], 1e-3)) for w in first}  # and their weights
    leading = set(first[:VARIED])
    usual = sorted((w for w in neg if w not in seeds), key=lambda w: (-min(neg[w], 5), _order(w)))
    others = set(usual[:3000]) | set(sorted(usual, key=_order)[:5000])
    pool = sorted((w for w in neg if w not in seeds), key=_order)[:60_000]
    for _ in range(rounds):
        good, bad = sorted(seeds, key=_order), sorted(others, key=_order)
        more = [[v for v in inserted(w) if v not in neg] for w in good if w in leading]
        weight = [seeds[w] for w in good] + [VARIED_WEIGHT * seeds[w] / len(vs) for w, vs in zip([w for w in good if w in leading], more) for _ in vs] + [1.0] * len(bad)
        marks = sorted(good, key=lambda w: (-seeds[w], w))[: landmarks // 2]
        marks += bad[: landmarks - len(marks)]
        places, own = landmark_weights(marks)
        value, vector = np.linalg.eigh((own @ own.T).astype(np.float64))
        keep = value > 1e-6 * value[-1]
        root = vector[:, keep] / np.sqrt(value[keep])  # K^(-1/2), in its own axes
        nystrom = np.zeros((len(places) + 1, root.shape[1]), np.float32)  # a row for each place of the landmarks', and one of zeros for all others
        np.matmul(own.T, root.astype(np.float32), out=nystrom[:-1])
        rows = np.full(PLACES, len(places))
        rows[places] = np.arange(len(places))
        words = good + [v for vs in more for v in vs]
        x1 = np.zeros((len(words) + len(bad), root.shape[1] + 1))
        dot(words + bad, nystrom, rows, x1[:, :-1])
        x1[:, -1] = 1
        y = np.concatenate((np.ones(len(words)), -np.ones(len(bad))))
        w, bias = machine(x1, y, np.array(weight)) if len(bad) else (np.zeros(root.shape[1]), 0.0)
        at_places = np.zeros(PLACES, np.float32)
        at_places[places] = nystrom[:-1] @ w.astype(np.float32)
        model = Model(at_places, bias, np.zeros(TOP + 2))
        del own, nystrom, x1  # what follows doesn't need them
        # its errors on clean documents
        s = model.word_scores(pool)
        others |= {pool[k] for k in np.argsort(-s, kind="stable")[:3000] if s[k] > -0.6}
        # toxic documents that hold no positive: their best word, if it's near enough
        missed = [b for b in toxic if not b & seeds.keys()]
        by = dict(zip(words := sorted(set().union(*missed)), model.word_scores(words).tolist()))
        for b in missed:
            new = [w for w in b if not neg[w] and by[w] > 0]
            if new:
                seeds.setdefault(max(new, key=lambda w: (by[w], w)), min(seeds.values()))
    # toxic documents come again with their insults altered
    change = {w: altered(w) for w in leading}
    again = [b for b, y in bags if y == 1 and b & leading]
    x = evidence(np.concatenate((_tops_of([b for b, _ in bags], model), _tops_of(again, model, change))))
    weights = np.concatenate((np.ones(len(bags)), np.full(len(again), ALTERED_WEIGHT)))
    return Model(model.weights, model.bias, _curve(x, np.array([label for _, label in bags] + [1] * len(again), np.float64), weights))


def _tops_of(bags: list[set[str]], model: Model, change: dict[str, str] | None = None) -> np.ndarray:
    """Scores of each bag's TOP most toxic words; change: words that stand for others."""
    out = np.full((len(bags), TOP), FLOOR)
    for at in range(0, len(bags), BLOCK):
        some = [{change.get(w, w) for w in b} if change else b for b in bags[at : at + BLOCK]]
        words = sorted(set().union(*some))
        by = dict(zip(words, np.maximum(model.word_scores(words), FLOOR).tolist()))
        for k, b in enumerate(some, at):
            best = sorted(map(by.__getitem__, b), reverse=True)[:TOP]
            out[k, : len(best)] = best
    return out


def _curve(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of the columns of s, none below 0, and a constant, of the logistic curve through (s, y), rows weighed by w; by Newton steps with a little penalty."""
    keep = list(range(s.shape[1]))
    while True:
        x = np.concatenate((s[:, keep], np.ones((len(s), 1))), axis=1)

        def loss(p: np.ndarray) -> float:
            return float((w * np.logaddexp(0, -(2 * y - 1) * (x @ p))).sum() + 0.005 * p @ p)  # noqa: B023

        p = np.zeros(x.shape[1])
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
            g = x.T @ (w * (q - y)) + 0.01 * p
            h = (x * (w * q * (1 - q))[:, None]).T @ x + 0.01 * np.eye(len(p))
            step, size = np.linalg.solve(h, g), 1.0
            while size > 1e-6 and loss(p - size * step) > loss(p) - 1e-4 * size * (g @ step):
                size /= 2
            p = p - size * step
            if np.abs(size * step).max() < 1e-8:
                break
        if not keep or p[:-1].min() >= 0:
            break
        del keep[int(p[:-1].argmin())]  # a more toxic word never makes a text less toxic
    out = np.zeros(s.shape[1] + 1)
    out[keep], out[-1] = p[:-1], p[-1]
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_labelled"), F.col("toxic").cast("int").alias("_toxic"))
    rows = [known.where(F.col("_toxic") == y).orderBy(F.xxhash64("_labelled"), "_labelled").limit(max_rows) for y in (0, 1)]
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rows[0].unionByName(rows[1])), F.col("doc_id") == F.col("_labelled")).select("doc_id", "_toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [" ".join(sorted({p for w in words_of(t or "") for p in letters(w)})) for t in as_list(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.string())], names=["doc_id", "toxic", "bag"])

    found = sorted(tuple(r) for r in sample.mapInArrow(run, "doc_id long, toxic int, bag string").collect())
    bags = bags_of((b, y) for _, y, b in found)
    del found
    return fit(bags)


_scores: dict[int, tuple[dict[str, float], dict[str, str]]] = {}


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score; a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        if id(model) not in _scores:
            _scores.clear()
        cache, toxic = _scores.setdefault(id(model), ({}, {}))  # scores of words, and the letters of those on the toxic side
        for batch in batches:
            texts, out = as_list(batch, "text"), []
            for at in range(0, len(texts), 200):
                bags = [words_of(t) if t else set() for t in texts[at : at + 200]]
                if model is None:
                    out += [0.0] * len(bags)
                    continue
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                    toxic.clear()
                new = list(set().union(*bags).difference(cache))
                for k in range(0, len(new), 20_000):
                    some = new[k : k + 20_000]
                    pieces = [letters(w) for w in some]
                    flat = [p for ps in pieces for p in ps]
                    got, i = model.word_scores(flat).tolist(), 0
                    for w, ps in zip(some, pieces):
                        best = max(range(i, i + len(ps)), key=got.__getitem__, default=None)
                        cache[w] = FLOOR if best is None else max(got[best], FLOOR)
                        if cache[w] > 0:
                            toxic[w] = flat[best]
                        i += len(ps)
                tops = np.full((len(bags), TOP), FLOOR)
                for k, b in enumerate(bags):
                    tops[k, 0] = max(map(cache.__getitem__, b), default=FLOOR)
                    if tops[k, 0] > 0:  # words that differ in marks alone are one
                        each = sorted({toxic[w]: cache[w] for w in b if w in toxic}.values(), reverse=True)[:TOP]
                        tops[k, : len(each)] = each
                out += model.probability(tops).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
