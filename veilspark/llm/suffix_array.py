"""Suffix-array dedup: removes every byte that a repeated string of `size` bytes covers.

Passages that may repeat (see repeats.py) are dealt to shards by anchor, so equal windows
meet in one shard; those of an anchor with one passage alone, however often it occurs, are
settled by its count. A shard of bounded size builds the suffix array of its passages by
Larsson-Sadakane refinement, in numpy and down to `size` bytes, with groups that are down to one
suffix left out of later rounds; common prefixes of neighbours follow by Kasai's rule
(along a diagonal the prefix shrinks by one, so only where a diagonal begins is anything
compared). Windows with a neighbour that shares `size` bytes are repeated. Shards need
no merging, as equal windows never lie in two; the passages of an anchor that has more than
LARGE different ones or more than LARGE_BYTES of them, which would outgrow a shard, never meet in a task: digests of blocks of their windows, and of
windows where blocks differ, are merged by Spark's sorted aggregation and join instead of by binary search in shards.

Defined results: null and empty texts have no bytes. Matches never cross documents; rows
that are equal, doc_id included, are documents of their own, so both lose what they share.
Null doc_ids are like any other. Texts shorter than `size` bytes stay whole. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, as_list, dealt, settled, unsettle
from veilspark.llm.repeats import PLACE_BITS, bytes_kind, candidates, keyed, least_places

SIZE, SHARD_BYTES = 400, 1 << 20
#: Different passages of an anchor, and bytes of them, beyond which these are told by window digests.
LARGE, LARGE_BYTES = 5_000, 1 << 20


def suffix_array(data: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of data in order of their first `depth` bytes, and their groups: equal numbers for equal first bytes. Data counts as followed by zeros.

    Larsson-Sadakane: a suffix's number is its group's first place in the order; a round
    triples the sorted depth through the numbers further on, in groups of several alone.
    """
    n = len(data)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    key = np.zeros(n, np.uint64)
    for k in range(min(8, depth)):
        key |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * (7 - k))
    order = np.argsort(key, kind="stable")
    sorted_keys = key[order]
    head = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.full(n + 2 * depth + 16, -1, np.int64)  # beyond the end: before all
    rank[order] = start
    known = min(8, depth)
    bits = max(1, int(n + 1).bit_length())
    alone = head & np.concatenate((head[1:], [True]))
    live = np.flatnonzero(~alone)  # places in the order
    while known < depth and len(live):
        step1 = min(known, depth - known)
        step2 = min(2 * known, depth - known)
        p = order[live]
        a, b = rank[p + step1] + 1, rank[p + step2] + 1
        if 3 * bits <= 63:
            k = (rank[p] << (2 * bits)) | (a << bits) | b
            by = np.argsort(k, kind="stable")
            k = k[by]
            head = np.concatenate(([True], k[1:] != k[:-1]))
        else:
            by = np.lexsort((b, a, rank[p]))
            x = np.stack((rank[p], a, b))[:, by]
            head = np.concatenate(([True], (x[:, 1:] != x[:, :-1]).any(axis=0)))
        p = p[by]
        order[live] = p
        start = np.maximum.accumulate(np.where(head, live, 0))
        rank[p] = start
        known = min(depth, known + step2)
        live = live[~(head & np.concatenate((head[1:], [True])))]
    return order, rank[:n]


def common_prefixes(data: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix (by place in data) the length of the prefix it shares with its predecessor in the order, counted up to `most`.

    Kasai: if suffix i and predecessor p share l > 0 bytes and p + 1 precedes i + 1, those
    share l - 1. Prefixes are counted where such a diagonal begins, and follow elsewhere.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    begins = np.ones(n, bool)
    begins[1:] = (before[1:] < 0) | (before[:-1] < 0) | (before[1:] != before[:-1] + 1)
    # a diagonal is counted anew every `most` steps, as counts stop there
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(begins, at, 0))
    begins |= (at - last) % most == 0
    heads = np.flatnonzero(begins & (before >= 0))
    padded = np.frombuffer(data + bytes(2 * most + 8), np.uint8)
    limit = n - np.maximum(heads, before[heads])
    got = np.zeros(len(heads), np.int64)
    live = np.arange(len(heads))
    reach = 2 * most  # so that what follows along a diagonal is right up to `most`
    while len(live):
        a, b = heads[live] + got[live], before[heads[live]] + got[live]
        same = padded[a[:, None] + np.arange(16)] == padded[b[:, None] + np.arange(16)]
        run = np.where(same.all(axis=1), 16, same.argmin(axis=1))
        got[live] += run
        live = live[(run == 16) & (got[live] < np.minimum(reach, limit[live]))]
    got = np.minimum(got, limit)
    full = np.zeros(n, np.int64)
    full[heads] = got + heads
    out = np.maximum(full[np.maximum.accumulate(np.where(begins, at, 0))] - at, 0)
    out[before < 0] = 0
    return np.minimum(out, most)


def repeated(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text, the starts of its windows that occur elsewhere in texts, itself included."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < size:
        return [np.zeros(0, np.int64) for _ in texts]
    order, rank = suffix_array(data, size)
    end = np.repeat(ends, [len(t) for t in texts])
    whole = np.arange(len(data)) + size <= end  # windows that stay in their text
    # only suffixes that hold a whole window and share their group are neighbours worth counting
    placed = order[whole[order]]
    shared = np.zeros(len(data), bool)
    if len(placed) > 1:
        pair = rank[placed[1:]] == rank[placed[:-1]]
        near = np.unique(np.concatenate((np.flatnonzero(pair), np.flatnonzero(pair) + 1)))
        if len(near):
            few = placed[near]
            lcp = common_prefixes(data, few, size)
            hit = lcp[few] >= size  # with its predecessor
            shared[few[hit]] = True
            shared[few[np.flatnonzero(hit) - 1]] = True
    at = np.flatnonzero(shared)
    cut = np.searchsorted(at, np.concatenate(([0], ends)))
    return [at[a:b] - (e - len(t)) for a, b, e, t in zip(cut[:-1], cut[1:], ends, texts)]


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]


def _shards(size: int, shard_bytes: int):
    """Rows come sorted by anchor: anchor, digest, several, data. Gives digest, from, to of repeated runs of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}
        total = [0]
        group: dict[bytes, bytes] = {}
        inner: set[bool] = set()
        now = None

        def solve():
            names = list(held)
            rows = []
            for name, at in zip(names, repeated([held[x] for x in names], size)):
                if len(at):
                    rows += [(name, a, b) for a, b in zip(*(x.tolist() for x in runs(at)))]
            held.clear()
            total[0] = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()))], names=["digest", "a", "b"]) if rows else None

        def close():
            if len(group) > 1 or True in inner:  # one passage may repeat in itself
                held.update(group)
                total[0] += sum(map(len, group.values()))
            group.clear()
            inner.clear()

        for batch in batches:
            for anchor, digest, several, data in zip(*(as_list(batch, c) for c in ("anchor", "digest", "several", "data"))):
                if anchor != now:
                    close()
                    now = anchor
                    if total[0] >= shard_bytes and (out := solve()) is not None:
                        yield out
                group[digest] = data
                inner.add(several)
        close()
        if held and (out := solve()) is not None:
            yield out

    return run


#: Windows of a block: consecutive ones whose least gram is at one place, dealt by their distance from it.
BLOCK = 16


def _blocks(size: int):
    """digest, a, b (a block's windows), core and whole (digests of what all windows of such a block hold, and of all that these hold).

    A window's distance from its least gram follows from its bytes alone. So equal windows are in blocks of one core, and blocks of one
    whole have the same windows.
    """
    kind = bytes_kind(size)
    width = size - kind.gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, data in zip(as_list(batch, "digest"), as_list(batch, "data")):
                n = len(data) - size + 1
                place = least_places(kind.grams([data])[0][: n + width - 1], width, PLACE_BITS)
                far = place - np.arange(n)
                cut = np.flatnonzero((place[1:] != place[:-1]) | (far[1:] // BLOCK != far[:-1] // BLOCK)) + 1
                first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [n - 1]))
                core, whole = [], []
                for a, b, p, d in zip(first.tolist(), last.tolist(), place[first].tolist(), far[first].tolist()):
                    q = d // BLOCK
                    at = p - BLOCK * q
                    core.append(xxhash.xxh3_128_digest(data[at : at - BLOCK + 1 + size] + b"%d" % q))
                    whole.append(xxhash.xxh3_128_digest(data[a : b + size] + b"%d" % d))
                for k in range(0, len(first), 10_000):
                    part = slice(k, k + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(core[part]), pa.binary()), pa.array(first[part]), pa.array(last[part]), pa.array(core[part], pa.binary()), pa.array(whole[part], pa.binary())], names=["digest", "a", "b", "core", "whole"])

    return run


def _window_digests(size: int):
    """digest, a (a window's place), w (of the window), alone (of its block); of the blocks listed for each passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, data, blocks in zip(as_list(batch, "digest"), as_list(batch, "data"), as_list(batch, "blocks")):
                rows = [(k, x["alone"]) for x in blocks for k in range(x["a"], x["b"] + 1)]
                for at in range(0, len(rows), 10_000):
                    some = rows[at : at + 10_000]
                    w = [xxhash.xxh3_128_digest(data[k : k + size]) for k, _ in some]
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(w), pa.binary()), pa.array([k for k, _ in some], pa.int64()), pa.array(w, pa.binary()), pa.array([x for _, x in some])], names=["digest", "a", "w", "alone"])

    return run


def large_runs(passages: DataFrame, size: int) -> DataFrame:
    """digest, a, b: repeated windows of passages (digest, data) that never meet in a task. Written to the shared folder.

    A digest for each window would take 40 bytes for each byte. So blocks of windows are compared: those whose core is nowhere else
    hold nothing repeated, those whose whole is elsewhere are repeated throughout, and only different wholes of one core, each once,
    are compared window by window.
    """
    # tasks may have sent a passage twice
    passages = settled(passages.dropDuplicates(["digest"]))
    blocks = settled(passages.mapInArrow(_blocks(size), "digest binary, a long, b long, core binary, whole binary"))
    cores = blocks.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    near = settled(blocks.join(cores, "core", "left_semi"))
    unsettle(blocks)
    wholes = settled(near.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("digest", "a", "b")).alias("one")))
    mixed = wholes.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core")
    each = wholes.join(mixed, "core", "left_semi").select("one.digest", F.struct("one.a", "one.b", (F.col("n") == 1).alias("alone")).alias("block"))
    listed = each.groupBy("digest").agg(F.collect_list("block").alias("blocks"))
    windows = settled(passages.join(listed, "digest").select("digest", "data", "blocks").mapInArrow(_window_digests(size), "digest binary, a long, w binary, alone boolean"))
    twice = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    single = as_runs(windows.where("alone").join(twice, "w", "left_semi"))
    copied = near.join(wholes.where("n > 1").select("whole"), "whole", "left_semi").select("digest", "a", "b")
    out = settled(single.unionByName(copied))
    for made in (passages, near, wholes, windows):
        unsettle(made)
    return out


def repeated_runs(found: DataFrame, size: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """digest, a, b: runs of windows a .. b of a passage that occur elsewhere. found: of candidates(). Written to the shared folder."""
    few = found.where("data is not null and not large").select("anchor", "digest", "several", "data")
    out = dealt(few, "anchor").sortWithinPartitions("anchor").mapInArrow(_shards(size, shard_bytes), "digest binary, a long, b long")
    many = large_runs(found.where("data is not null and large").select("digest", "data"), size)
    parts = settled(out.unionByName(many))
    unsettle(many)
    return parts


def as_runs(windows: DataFrame) -> DataFrame:
    """digest, a, b: runs of consecutive windows of a passage, from single ones (digest, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(digest, a, b) for digest, at in zip(as_list(batch, "digest"), as_list(batch, "at")) for a, b in zip(*(x.tolist() for x in runs(np.unique(np.array(at, np.int64)))))]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64()))], names=["digest", "a", "b"])

    return windows.groupBy("digest").agg(F.collect_list("a").alias("at")).mapInArrow(run, "digest binary, a long, b long")


def spans(docs: DataFrame, size: int = SIZE, shard_bytes: int = SHARD_BYTES, large: int = LARGE, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """doc_id, th, spans (array of a, b: bytes a .. b - 1 go); docs: of keyed(). For documents that lose any."""
    found = candidates(docs, bytes_kind(size), large, large_bytes)
    parts = repeated_runs(found, size, shard_bytes)
    times = found.groupBy("digest").agg(F.count("*").alias("times"))
    inside = parts.groupBy("digest").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    judged = times.join(inside, "digest", "left").where("times > 1 or runs is not null")
    hit = found.select("doc_id", "th", "digest", "first", "windows").join(judged, "digest")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("windows") - 1).alias("b")))
    each = hit.select("doc_id", "th", "first", F.explode(F.when(F.col("times") > 1, whole).otherwise(F.col("runs"))).alias("r"))
    out = settled(each.groupBy("doc_id", "th").agg(F.collect_set(F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b") + size).alias("b"))).alias("spans")))
    unsettle(found)
    unsettle(parts)
    return out


def merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text, spans (null if none), a row for each row of docs (of keyed())."""
    found = found.select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), "spans")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_doc_id"]) & (docs["th"] == found["_th"]), "left").select("doc_id", "text", "spans")


def deduplicate(docs: DataFrame, size: int = SIZE, shard_bytes: int = SHARD_BYTES, large: int = LARGE, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes), a row for each row of docs."""
    own = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(as_bytes(batch, "text"), as_list(batch, "spans")):
                gone = merge([(x["a"], x["b"]) for x in found or ()])
                at, kept = 0, []
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), b"".join(kept) + text[at:]))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_spans(own, spans(own, size, shard_bytes, large, large_bytes)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame, size: int = SIZE, shard_bytes: int = SHARD_BYTES, large: int = LARGE, large_bytes: int = LARGE_BYTES) -> DataFrame:
    return deduplicate(docs, size, shard_bytes, large, large_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
