r"""Periodic runs of words: stretches that repeat with some period, and texts without the repeats.

A run is a stretch of consecutive words [^\x20\x09-\x0D]+ whose smallest period is q, at least max(6, 4q) words
long, that can't be extended either way with that period.

For a period p, words p apart agree over at least max(6, 4p) - p places of a run, so one of the places at every
so many words lies in it. All (period, grid place) pairs of a block of texts, of which there are n log n for n words,
are looked at together: where the words agree, prefix hashes tell by binary search how far they agree in both
directions; hashes may only say too much, so what they say is verified on the words and corrected. A run is met
once for each grid place in it and again for multiples of its period; the smallest period stays.

Null, empty and blank texts have no words and no runs. Rows are taken by themselves: repeated ids, ties and
other columns make no difference, and empty tables give no rows. A text of any length is gone through in
bounded groups of pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, as_list

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Bytes of text whose pairs are looked at together, and pairs at once.
BLOCK, PAIRS = 1 << 20, 1 << 21
_BASE = 0x9E3779B97F4A7C15


def _prefixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of id * base^place modulo 2^64, and the powers."""
    n = len(ids)
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * powers[:n]))), powers


def _reach(sums: np.ndarray, powers: np.ndarray, i: np.ndarray, p: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many words from i on (way 1) or up to i - 1 back (way -1) agree with those p later, by hashes; all by binary search together."""
    got = np.zeros(len(i), np.int64)
    if not len(i):
        return got
    scale = powers[p]
    step = 1 << int(most.max()).bit_length()
    while step:
        tried = got + step
        ok = np.flatnonzero(tried <= most)
        if len(ok):
            a = i[ok] if way > 0 else i[ok] - tried[ok]
            b = a + tried[ok]
            same = (sums[b] - sums[a]) * scale[ok] == sums[b + p[ok]] - sums[a + p[ok]]
            got[ok[same]] = tried[ok[same]]
        step >>= 1
    return got


def _agreeing(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Groups of (period, place, text's number) in which the words at the place and a period later agree, and a neighbouring pair does."""
    n = ends - starts
    periods = np.where(n >= LEAST, n // TIMES, 0)
    # a row for each text and period, as many texts at a time as make a bounded number of rows
    cut = np.searchsorted(np.cumsum(periods), np.arange(PAIRS, periods.sum() + PAIRS, PAIRS), "left") + 1
    for a, b in zip(np.concatenate(([0], cut[:-1])), np.minimum(cut, len(n))):
        of = np.repeat(np.arange(a, b), periods[a:b])
        if not len(of):
            continue
        p = np.arange(1, len(of) + 1) - np.repeat(np.cumsum(periods[a:b]) - periods[a:b], periods[a:b])
        step = np.maximum(LEAST, TIMES * p) - p
        grid = (n[of] - p) // step
        rows = np.cumsum(grid)
        at = 0
        while at < len(of):  # rows whose grid places are at most PAIRS, or one row
            stop = max(at + 1, int(np.searchsorted(rows, (rows[at - 1] if at else 0) + PAIRS, "right")))
            row = np.repeat(np.arange(at, stop), grid[at:stop])
            nth = np.arange(len(row)) - np.repeat(rows[at:stop] - grid[at:stop] - (rows[at - 1] if at else 0), grid[at:stop])
            place = starts[of[row]] + (nth + 1) * step[row] - 1
            equal = np.flatnonzero(ids[place] == ids[place + p[row]])
            row, place = row[equal], place[equal]
            # a run's agreeing places are at least five, so a neighbour of this one agrees as well
            left = place > starts[of[row]]
            beside = left & (ids[place - left] == ids[place - left + p[row]])
            right = place + 1 + p[row] < ends[of[row]]
            beside |= right & (ids[place + right] == ids[place + right + p[row]])
            row, place = row[beside], place[beside]
            if len(row):
                yield p[row], place, of[row]
            at = stop


def _exact(ids: np.ndarray, start: int, end: int, p: int) -> list[tuple[int, int]]:
    """All stretches of a text that agree with the words p later and are long enough, looked at word by word; for periods of which hashes said too much."""
    same = np.concatenate(([False], ids[start : end - p] == ids[start + p : end], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(start + a, start + b + p) for a, b in edges.reshape(-1, 2).tolist() if b - a + p >= max(LEAST, TIMES * p)]


def runs(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of joined texts of word numbers: text, start in it, length, period; by text, start and period."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    sums, powers = _prefixes(ids)
    found, known, scanned = [], {}, set()
    for p, place, of in _agreeing(ids, starts, ends):
        ahead = _reach(sums, powers, place, p, ends[of] - p - place, 1)
        back = _reach(sums, powers, place, p, place - starts[of], -1)
        lo, hi = place - back, place + ahead + p
        long = np.flatnonzero(hi - lo >= np.maximum(LEAST, TIMES * p))
        if not len(long):
            continue
        for o, a, b, q in np.unique(np.stack((of[long], lo[long], hi[long], p[long]), 1), axis=0).tolist():
            if q % known.get((a, b), q + 1) == 0 or (o, q) in scanned:
                continue  # a multiple of a period that was verified
            if np.array_equal(ids[a : b - q], ids[a + q : b]):
                true = [(a, b)]
            else:
                scanned.add((o, q))
                true = _exact(ids, int(starts[o]), int(ends[o]), q)
            for a, b in true:
                known[a, b] = min(q, known.get((a, b), q))
                found.append((o, a, b, q))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    every = np.unique(np.array(found, np.int64), axis=0)  # by text, start, end, period
    new = np.concatenate(([True], (every[1:, :3] != every[:-1, :3]).any(axis=1)))
    of, a, b, q = every[new].T
    order = np.lexsort((q, a, of))
    return of[order], (a - starts[of])[order], (b - a)[order], q[order]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a text of n words begins to repeat, and by which period; for a tenth of the ids, by their checksum. Null ids have none."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _best(start: list[int], length: list[int], period: list[int]) -> int:
    """The run of the greatest exact length/period, then the smallest start and period."""
    best = 0
    for k in range(1, len(start)):
        more, less = length[k] * period[best], length[best] * period[k]
        if more > less or more == less and (start[k], period[k]) < (start[best], period[best]):
            best = k
    return best


OUT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def detect(docs: DataFrame, plant: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """doc_id, n_words, n_runs, the run of the greatest exponent, all runs, and the text without repeats (words joined by one space).

    plant: for a doc_id and its number of words, where to make the text periodic first, and by which period.
    """

    def block(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        next_ = count().__next__
        words, codes = [], []
        for doc_id, text in zip(ids, texts):
            own = text.split()
            if plant and (at := plant(doc_id, len(own))):
                own = own[: at[0]] + (own[at[0] : at[0] + at[1]] * -(-(len(own) - at[0]) // at[1]))[: len(own) - at[0]]
            words.append(own)
            for w in own:
                if w not in numbers:
                    numbers[w] = next_()
            codes.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
        lengths = np.array([len(c) for c in codes], np.int64)
        of, start, length, period = runs(np.concatenate(codes), lengths)
        cut = np.searchsorted(of, np.arange(len(ids) + 1)).tolist()
        rows = []
        for k, (doc_id, own) in enumerate(zip(ids, words)):
            s, n, q = (x[cut[k] : cut[k + 1]].tolist() for x in (start, length, period))
            if not s:
                rows.append((doc_id, len(own), 0, None, None, None, None, [], b" ".join(own)))
                continue
            gone = np.zeros(len(own) + 1, np.int64)
            np.add.at(gone, [a + x for a, x in zip(s, q)], 1)
            np.add.at(gone, [a + x for a, x in zip(s, n)], -1)
            gone = np.cumsum(gone)[:-1] > 0
            i = _best(s, n, q)
            each = [{"start": a, "length": b, "period": c} for a, b, c in zip(s, n, q)]
            rows.append((doc_id, len(own), len(s), s[i], n[i], q[i], 1000 * n[i] // q[i], each, b" ".join(w for w, g in zip(own, gone.tolist()) if not g)))
        kinds = [pa.int64()] * 7 + [pa.list_(_RUN), pa.binary()]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        cols[-1] = cols[-1].cast(pa.string())
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = as_list(batch, "doc_id"), [t or b"" for t in as_bytes(batch, "text")]
            at = size = 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK or k == len(texts) - 1:
                    yield block(ids[at : k + 1], texts[at : k + 1])
                    at, size = k + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def report(docs: DataFrame) -> DataFrame:
    """Of texts in which a tenth of the ids get a planted run: doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the text without repeats."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    found = detect(docs, planted)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
