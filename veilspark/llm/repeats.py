"""Finding what may repeat across a corpus, for the operators on repeated strings.

A window is a run of `size` units (bytes or words) of one document. Its anchor is the
least hash of its k-grams, which follows from its units alone: equal windows have equal
anchors, wherever they are. Consecutive windows with one anchor make a passage. Only
passages whose anchor occurs more than once in the corpus can hold a repeated window; the
rest of the corpus never leaves its documents. Equal passages are told by a digest and
kept once, so copies of a document, however many, cost one passage each and a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, as_list, settled, unsettle

#: Bytes of text that are worked on at once; a text is never split.
BLOCK = 1 << 20
#: Low bits of a hash that give way to its place; longer texts are gone through in runs of windows.
PLACE_BITS = 24


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the 16 bytes at each place of the joined texts, and the texts' lengths."""
    data = b"".join(texts) + bytes(24)
    n = len(data) - 24
    eight = np.empty(n + 8, np.uint64)
    for k in range(8):  # the 8 bytes at every eighth place, for each first place
        part = eight[k::8]
        part[:] = np.frombuffer(data, "<u8", len(part), k)
    eight = mix(eight * np.uint64(0x9E3779B97F4A7C15))
    return mix(eight[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + eight[8 : n + 8]), np.array([len(t) for t in texts], np.int64)


_PRIME, _POWERS = 0x9E3779B97F4A7C15, {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if n > len(_POWERS.get("p", ())):
        m = max(n, 2 * BLOCK)
        for name, base in (("p", _PRIME), ("q", pow(_PRIME, -1, 1 << 64))):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def word_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the 4 words at each word of the joined texts (words joined by one space, one more at the end), and the texts' numbers of words."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.flatnonzero(data == 32)
    counts = np.array([t.count(b" ") for t in texts], np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64), counts
    p, q = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)])))
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    h = np.concatenate((h, np.zeros(3, np.uint64)))
    n = len(ends)
    out = h[:n].copy()
    for k in range(1, 4):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : k + n])
    return out, counts


@dataclass(frozen=True)
class Kind:
    size: int
    gram: int
    grams: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    #: A text in the form in which its units are consecutive.
    form: Callable[[bytes], bytes]
    words: bool

    def places(self, text: bytes) -> np.ndarray | None:
        """Byte at which each unit begins, and one for the end."""
        return np.concatenate(([0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1)) if self.words else None


def bytes_kind(size: int) -> Kind:
    return Kind(size, 16, byte_grams, lambda t: t, False)


def _spaced(text: bytes) -> bytes:
    words = text.split()
    return b" ".join(words) + b" " if words else b""


def words_kind(size: int) -> Kind:
    return Kind(size, 4, word_grams, _spaced, True)


def least_places(h: np.ndarray, w: int, bits: int) -> np.ndarray:
    """For each run of w hashes the place of the least (the leftmost of equals), as far as all but their low `bits` tell."""
    m, step = len(h) - w + 1, (1 << bits) - w + 1
    if step < 1:
        raise ValueError("a window has more places than bits can tell")
    low, out = np.uint64((1 << bits) - 1), []
    for at in range(0, m, step):
        n = min(step, m - at)
        least = (h[at : at + n + w - 1] & ~low) | np.arange(n + w - 1, dtype=np.uint64)
        wide = 1
        while 2 * wide <= w:  # the least of twice as many at each step
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        out.append((np.minimum(least[:n], least[w - wide : w - wide + n]) & low).astype(np.int64) + at)
    return np.concatenate(out)


def passages(texts: list[bytes], kind: Kind, bits: int = PLACE_BITS) -> tuple[np.ndarray, ...]:
    """Passages of texts: text, first unit, number of windows, anchor, and whether an anchor is at several places in it."""
    return printed_passages(texts, kind, bits)[:5]


def printed_passages(texts: list[bytes], kind: Kind, bits: int = PLACE_BITS) -> tuple[np.ndarray, ...]:
    """As passages(), and the sum of each one's gram hashes, by which different ones can be counted."""
    h, lengths = kind.grams(texts)
    n, w = len(h), kind.size - kind.gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool, np.int64))
    m = n - kind.size + 1
    if m < 1:
        return none
    place = least_places(h[: m + w - 1], w, bits)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # where a text begins, and where the least gram moves, as far as windows lie in their text
    at = np.union1d(np.flatnonzero(place[1:] != place[:-1]) + 1, starts[lengths >= kind.size])
    text = np.searchsorted(ends, at, "right")
    held = at + kind.size <= ends[text]
    at, text = at[held], text[held]
    if not len(at):
        return none
    anchor = h[place[at]]
    head = np.concatenate(([True], anchor[1:] != anchor[:-1])) | (at == starts[text])
    first = np.flatnonzero(head)
    begin, which = at[first], text[first]
    stop = ends[which] - kind.size + 1
    later = np.concatenate((begin[1:], [m]))
    windows = np.minimum(later, stop) - begin
    several = np.diff(np.concatenate((first, [len(at)]))) > 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
    prints = sums[begin + windows + w - 1] - sums[begin]
    return which, begin - starts[which], windows, anchor[first].view(np.int64), several, prints.view(np.int64)


def _blocks(texts: list[bytes | None], kind: Kind) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts in their form, about BLOCK bytes of them; the first's number."""
    held, size, at = [], 0, 0
    for k, t in enumerate(texts):
        held.append(kind.form(t or b""))
        size += len(held[-1])
        if size >= BLOCK:
            yield at, held
            held, size, at = [], 0, k + 1
    if held:
        yield at, held


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, th (a hash that tells rows with one doc_id apart), text, and more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), *more)


def anchors(docs: DataFrame, kind: Kind) -> DataFrame:
    """doc_id, th, anchor, n (2 if it's at several places), units and print (of the passage) for documents that have windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0), batch.column(1)
            for at, texts in _blocks(as_bytes(batch, "text"), kind):
                which, _, windows, anchor, several, prints = printed_passages(texts, kind)
                if len(which):
                    rows = pa.array(which + at)
                    yield pa.RecordBatch.from_arrays([ids.take(rows), ths.take(rows), pa.array(anchor), pa.array(1 + several.astype(np.int64)), pa.array(windows + kind.size - 1), pa.array(prints)], names=["doc_id", "th", "anchor", "n", "units", "print"])

    return docs.mapInArrow(run, "doc_id long, th long, anchor long, n long, units long, print long")


#: Anchors that may be broadcast to be looked at more closely.
BROADCAST_ANCHORS = 500_000


def repeated_anchors(found: DataFrame, large: int, large_units: int) -> tuple[DataFrame, DataFrame]:
    """anchor, large: of anchors that occur more than once; and the table that this reads. found: of anchors()."""
    repeated = settled(found.groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("units").alias("units")).where("n > 1"))
    # copies count once, so anchors that exceed a bound with them are looked at again
    suspects = repeated.where((F.col("n") > large) | (F.col("units") > large_units)).select("anchor")
    n = suspects.count()
    if not n:
        return repeated.select("anchor", F.lit(False).alias("large")), repeated
    each = found.join(F.broadcast(suspects) if n <= BROADCAST_ANCHORS else suspects, "anchor").groupBy("anchor", "print").agg(F.max("units").alias("units"))
    sizes = each.groupBy("anchor").agg(F.count("*").alias("_n"), F.sum("units").alias("_units")).where((F.col("_n") > large) | (F.col("_units") > large_units)).select("anchor", F.lit(True).alias("large"))
    both = repeated.select("anchor").join(F.broadcast(sizes) if n <= BROADCAST_ANCHORS else sizes, "anchor", "left")
    return both.select("anchor", F.coalesce("large", F.lit(False)).alias("large")), repeated


_PASSAGE = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("anchor", pa.int64()), ("digest", pa.binary()), ("first", pa.int64()), ("windows", pa.int64()), ("several", pa.bool_()), ("large", pa.bool_()), ("data", pa.binary())])


def candidates(docs: DataFrame, kind: Kind, large: int, large_units: int) -> DataFrame:
    """Passages whose anchor occurs more than once: doc_id, th, anchor, digest, first, windows, several (its anchor is at several places in it), large (its anchor has more than `large` different passages, or more than `large_units` units of them, so that what meets in a task is bounded in both), and data (null where the task has met the passage before). docs: of keyed(). Written to the shared folder."""
    found = settled(anchors(docs, kind))
    repeated, counted = repeated_anchors(found, large, large_units)
    wanted = found.select("doc_id", "th", "anchor").join(repeated, "anchor").groupBy("doc_id", "th").agg(F.collect_set(F.struct("anchor", "large")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), "wanted")
    both = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_doc_id"]) & (docs["th"] == wanted["_th"])).select("doc_id", "th", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            ids, ths, lists = as_list(batch, "doc_id"), as_list(batch, "th"), batch.column(3)
            for at, texts in _blocks(as_bytes(batch, "text"), kind):
                which, first, windows, anchor, several = passages(texts, kind)
                sets = [{x["anchor"]: x["large"] for x in lists[at + k].as_py()} for k in range(len(texts))]
                cut = np.searchsorted(which, np.arange(len(texts) + 1))
                cols: list[list] = [[] for _ in _PASSAGE]
                for k, text in enumerate(texts):
                    a, b = cut[k], cut[k + 1]
                    here, names = sets[k], anchor[a:b].tolist()
                    places = kind.places(text)
                    for i, name in enumerate(names, a):
                        if name not in here:
                            continue
                        f, n = int(first[i]), int(windows[i])
                        last = f + n - 1 + kind.size
                        data = text[f:last] if places is None else text[places[f] : places[last] - 1]
                        digest = xxhash.xxh3_128_digest(data)
                        row = (ids[at + k], ths[at + k], name, digest, f, n, bool(several[i]), here[name], None if digest in met else data)
                        met.add(digest)
                        for c, x in zip(cols, row):
                            c.append(x)
                if len(met) > 500_000:  # a passage may then be sent again, which does no harm
                    met.clear()
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PASSAGE)], schema=_PASSAGE)

    out = settled(both.mapInArrow(run, "doc_id long, th long, anchor long, digest binary, first long, windows long, several boolean, large boolean, data binary"))
    unsettle(found)
    unsettle(counted)
    return out
