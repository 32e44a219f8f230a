"""Substring dedup: suffix automata of references, and matching statistics of documents.

Removes every word that a window of `size` words covers whose words also occur in a
document with a smaller doc_id. References are the distinct passages that may repeat (see
repeats.py), each with the smallest doc_id that has it. An automaton's states know the smallest
doc_id of what they stand for, so a passage's matching statistics (the longest match that ends
at each word) give the windows that an earlier document has; a passage's first document loses
those, other documents that have the same passage lose all of it.

An automaton of all references would grow with the corpus, so references are sharded by
anchor: equal windows share an anchor, and an anchor's automaton holds its distinct passages
alone and meets just the passages that have the anchor. Passages of an anchor that has more than
LARGE different ones or more than LARGE_WORDS words of them never meet in a task: their references
are cut to shards of SHARD_WORDS, whose automata are broadcast one after the other while the
passages stream by where they lie. Where that would take more than ROUNDS shards, the digests
of these anchors' windows are aggregated and joined in Spark, with the same result. `against` does the like
for a reference set from elsewhere.

Defined results: null and empty texts have no words. Rows with a null doc_id come after
all others and remove nothing from each other. Rows that share a doc_id are one document as
far as order goes: neither removes from the other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, as_list, dealt, settled, unsettle
from veilspark.llm.repeats import candidates, keyed, words_kind
from veilspark.llm.suffix_array import as_runs, merge, runs, with_spans

SIZE = 50
#: Different passages of an anchor, and words of them, beyond which these don't meet in one task.
LARGE, LARGE_WORDS = 5_000, 1 << 17
#: Words of references in a broadcast automaton, and how many such are broadcast at most.
SHARD_WORDS, ROUNDS = 1 << 17, 4
#: Bytes of reference texts whose automaton may be broadcast.
REFERENCE_BYTES = 32 << 20
#: Stands for a null doc_id.
LAST = (1 << 63) - 1


class Automaton:
    """Suffix automaton of sequences, grown a sequence at a time; each state knows the least mark of the sequences that hold it."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = [LAST]

    def add(self, items, mark: int = 0) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in items:
            q = nxt[last].get(c)
            if q is not None:  # the sequence so far is known
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                least[last] = min(least[last], mark)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            least.append(mark)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.least.append(LAST)  # settle() finds it
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def settle(self) -> None:
        """Hands least marks on to the suffixes of what they belong to; once, after all sequences."""
        link, least = self.link, self.least
        for s in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            if least[s] < least[link[s]]:
                least[link[s]] = least[s]

    def statistics(self, items) -> Iterator[tuple[int, int]]:
        """For each item, the length of the longest match that ends at it, and its state."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for c in items:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(c)
            if to is None:
                state = n = 0
            else:
                state, n = to, n + 1
            yield n, state


def windows_in(automaton: Automaton, items, size: int, before: int | None = None) -> np.ndarray:
    """Starts of the items' windows that the automaton holds; with `before`, of those of sequences with a lesser mark (after settle())."""
    link, length, least = automaton.link, automaton.length, automaton.least
    out = []
    for at, (n, state) in enumerate(automaton.statistics(items)):
        if n >= size:
            if before is not None:
                while length[link[state]] >= size:  # the state of the window itself
                    state = link[state]
                if least[state] >= before:
                    continue
            out.append(at - size + 1)
    return np.array(out, np.int64)


def _runs_of(found: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch | None:
    """digest, a, b for each run of windows."""
    rows = [(digest, a, b) for digest, at in found if len(at) for a, b in zip(*(x.tolist() for x in runs(at)))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()))], names=["digest", "a", "b"]) if rows else None


def _automaton_of(passages: list[tuple[bytes, int]]) -> tuple[Automaton, dict[bytes, int]]:
    """Of (text, mark), over numbers of words; the numbers."""
    automaton, number = Automaton(), {}
    for text, mark in passages:
        automaton.add([number.setdefault(w, len(number)) for w in text.split(b" ")], mark)
    automaton.settle()
    return automaton, number


def _shards(size: int):
    """Rows come sorted by anchor: anchor, digest and either least or data. Gives digest, a, b: runs of windows that a smaller document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least_of, data_of = None, {}, {}

        def solve() -> list[tuple[bytes, np.ndarray]]:
            """One anchor's passages; nothing if it has one alone: its first document loses none of it."""
            found = []
            if len(least_of) > 1:
                automaton, number = _automaton_of([(data_of[d], m) for d, m in least_of.items()])
                found = [(d, windows_in(automaton, [number[w] for w in data_of[d].split(b" ")], size, m)) for d, m in least_of.items()]
            least_of.clear()
            data_of.clear()
            return found

        for batch in batches:
            found = []
            for anchor, digest, least, data in zip(*(as_list(batch, c) for c in ("anchor", "digest", "least", "data"))):
                if anchor != now:
                    found += solve()
                    now = anchor
                if data is None:
                    least_of[digest] = least
                else:
                    data_of[digest] = data
            if (out := _runs_of(found)) is not None:
                yield out
        if (out := _runs_of(solve())) is not None:
            yield out

    return run


_broadcast: list[tuple[object, tuple[Automaton, dict[bytes, int]]]] = []  # the last one that this worker grew


def _streamed(passages: DataFrame, references: list[tuple[bytes, bytes, int]], size: int) -> DataFrame:
    """digest, a, b: runs of windows of passages (digest, least, data) that one of the references (digest, text, least) has from a smaller document. The references are broadcast."""
    sent = passages.sparkSession.sparkContext.broadcast([(text, least) for _, text, least in references])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _broadcast or _broadcast[0][0] is not sent.value:
            _broadcast[:] = [(sent.value, _automaton_of(sent.value))]
        automaton, number = _broadcast[0][1]
        for batch in batches:
            found = [(d, windows_in(automaton, [number.get(w, -1) for w in text.split(b" ")], size, least)) for d, least, text in zip(*(as_list(batch, c) for c in ("digest", "least", "data")))]
            if (out := _runs_of(found)) is not None:
                yield out

    return passages.select("digest", "least", "data").mapInArrow(run, "digest binary, a long, b long")


def _of_large(found: DataFrame, of: DataFrame, size: int, shard_words: int, rounds: int) -> DataFrame:
    """digest, a, b of the passages of large anchors."""
    large = of.where("large")
    dated = found.where("data is not null and large").select("digest", "data").join(large.select("digest", "least"), "digest")
    total = large.agg(F.sum(F.col("windows") + size - 1)).first()[0] or 0
    if not total:
        return found.sparkSession.createDataFrame([], "digest binary, a long, b long")
    if total <= shard_words * rounds and (dated.agg(F.sum(F.octet_length("data"))).first()[0] or 0) <= REFERENCE_BYTES:  # few enough to be gathered
        # tasks may have sent a passage twice
        rows = {bytes(r["digest"]): (bytes(r["data"]), r["least"]) for r in dated.collect()}
        shards: list[list[tuple[bytes, bytes, int]]] = [[]]
        words = 0
        for d, (text, least) in sorted(rows.items(), key=lambda x: (x[1][1], x[0])):
            if words >= shard_words:
                shards.append([])
                words = 0
            shards[-1].append((d, text, least))
            words += text.count(b" ") + 1
        parts = [_streamed(dated, references, size) for references in shards]
        return reduce(DataFrame.unionByName, parts)
    windows = settled(dated.mapInArrow(_window_digests(size), "digest binary, least long, w binary, a long"))
    first = windows.groupBy("w").agg(F.min("least").alias("earliest"), F.max("least").alias("latest")).where("earliest < latest").select("w", "earliest")
    return as_runs(windows.join(first, "w").where("earliest < least"))


def _window_digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, leasts, w, at = [], [], [], []
            for digest, least, data in zip(*(as_list(batch, c) for c in ("digest", "least", "data"))):
                words = data.split(b" ")
                ends = np.concatenate(([0], np.cumsum([len(x) + 1 for x in words]))).tolist()
                n = len(words) - size + 1
                digests += [digest] * n
                leasts += [least] * n
                w += [xxhash.xxh3_128_digest(data[ends[k] : ends[k + size] - 1]) for k in range(n)]
                at += range(n)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(leasts, pa.int64()), pa.array(w, pa.binary()), pa.array(at, pa.int64())], names=["digest", "least", "w", "a"])

    return run


def spans(docs: DataFrame, size: int = SIZE, large: int = LARGE, large_words: int = LARGE_WORDS, shard_words: int = SHARD_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, th, spans (array of a, b: words a .. b - 1 go); docs: of keyed(). For documents that lose any."""
    found = candidates(docs, words_kind(size), large, large_words)
    own = F.coalesce("doc_id", F.lit(LAST))
    of = settled(found.groupBy("digest").agg(F.min("anchor").alias("anchor"), F.bool_or("large").alias("large"), F.min(own).alias("least"), F.max(own).alias("most"), F.max("windows").alias("windows")))
    nothing = lambda kind: F.lit(None).cast(kind)
    few = of.where("not large").select("anchor", "digest", "least", nothing("binary").alias("data"))
    few = few.unionByName(found.where("data is not null and not large").select("anchor", "digest", nothing("long").alias("least"), "data"))
    parts_of = dealt(few, "anchor").sortWithinPartitions("anchor").mapInArrow(_shards(size), "digest binary, a long, b long")
    parts_of = parts_of.unionByName(_of_large(found, of, size, shard_words, rounds))
    parts = settled(parts_of)
    inside = parts.groupBy("digest").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    judged = of.where("least < most").select("digest", "least").join(inside, "digest", "full")
    judged = judged.select(F.col("digest").alias("_digest"), "least", "runs")
    hit = found.select("doc_id", "th", "digest", "first", "windows").join(judged, found["digest"] == judged["_digest"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("windows") - 1).alias("b")))
    # a passage's first document loses just what others had before it, the rest lose all
    later = F.col("least").isNotNull() & (own > F.col("least"))
    each = hit.select("doc_id", "th", "first", F.explode(F.when(later, whole).otherwise(F.col("runs"))).alias("r"))
    out = settled(each.groupBy("doc_id", "th").agg(F.collect_set(F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b") + size).alias("b"))).alias("spans")))
    for table in (found, of, parts):
        unsettle(table)
    return out


def _kept(texts: list[bytes], spans_of: list, ids: pa.Array) -> pa.RecordBatch:
    rows = []
    for text, found in zip(texts, spans_of):
        words, at, kept, gone = text.split(), 0, [], 0
        for a, b in merge([(x["a"], x["b"]) for x in found or ()]):
            kept += words[at:a]
            gone, at = gone + b - a, b
        rows.append((len(words), gone, b" ".join(kept + words[at:])))
    cols = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "n_words", "n_removed", "kept"])


def deduplicate(docs: DataFrame, size: int = SIZE, large: int = LARGE, **settings) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary: the remaining words joined by a space), a row for each row of docs."""
    own = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _kept(as_bytes(batch, "text"), as_list(batch, "spans"), batch.column(0))

    return with_spans(own, spans(own, size, large, **settings)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def against(docs: DataFrame, reference: DataFrame, size: int = SIZE, most_bytes: int = REFERENCE_BYTES) -> DataFrame:
    """docs less words covered by windows that a reference text (column text) holds; as deduplicate(). The references are broadcast as an automaton; ValueError if they're larger than most_bytes."""
    total = reference.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > most_bytes:
        raise ValueError(f"the references have {total} bytes; at most {most_bytes} may be broadcast")
    texts = sorted((r["text"] or "").encode() for r in reference.select("text").collect())
    sent = docs.sparkSession.sparkContext.broadcast([(b" ".join(t.split()), 0) for t in texts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _broadcast or _broadcast[0][0] is not sent.value:  # each worker grows the automaton once
            _broadcast[:] = [(sent.value, _automaton_of(sent.value))]
        automaton, number = _broadcast[0][1]
        for batch in batches:
            texts = as_bytes(batch, "text")
            found = []
            for t in texts:
                at = windows_in(automaton, [number.get(w, -1) for w in (t or b"").split()], size)
                found.append([{"a": a, "b": b + size} for a, b in zip(*(x.tolist() for x in runs(at)))] if len(at) else [])
            yield _kept([t or b"" for t in texts], found, batch.column(0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def report(docs: DataFrame, size: int = SIZE, large: int = LARGE, **settings) -> DataFrame:
    return deduplicate(docs, size, large, **settings).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
