"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two fingerprints of 64 bits that differ in at most 4 bits differ in at most 4 of their
8 bytes, so they share at least 4 positional bytes: the guaranteed minimum. Lists of
single positional bytes would be unusable (2,048 of them for any corpus), so the
inverted index is keyed by three positional bytes at once. TRIPLES is a Turan system:
any 4 of the 8 positions hold one of its 20 triples, so a pair within reach meets in at
least one list. In a list, the shared positional bytes of pairs are tallied, pairs below
the minimum fall out and the rest are verified by their differing bits.

Equal fingerprints are merged first, so copies cost a row. Lists give a spanning forest
of their links, never all their pairs; lists above `list_limit` are keyed again by a
fourth shared byte, which loses no link since four are guaranteed. Components come from
alternating large-star and small-star rounds over tables in the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like any other;
repeated rows give repeated result rows; null doc_ids are kept but are never a
component's smallest id, unless there is no other (then null). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, dealt, settled, unsettle

BITS, SHINGLE, SEED = 4, 4, 42
LIST_LIMIT = 20_000


def triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 positions such that any 4 positions hold one.

    Turan's construction: positions in three classes around a circle; a triple is taken
    if it lies in one class, or has two in a class and one in the next class.
    """
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        n = [sum(part[p] == k for p in t) for k in range(3)]
        if 3 in n or any(n[k] == 2 and n[(k + 1) % 3] == 1 for k in range(3)):
            out.append(t)
    return out


TRIPLES = triples()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return int(_fingerprints([text], shingle)[0])


def _fingerprints(texts: list[bytes | None], shingle: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = text.lower().split() if text else ()
        if not words:
            continue
        if len(words) <= shingle:
            out[k] = digest(b" ".join(words), SEED)
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a long), a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _fingerprints(as_bytes(batch, "text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def forest(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the linked members of one list, roots left out. fps: distinct, uint64."""
    rest = np.sort(fps)
    members, roots = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            diff = (rest ^ queue.pop()).view(np.uint8).reshape(-1, 8)
            near = (diff == 0).sum(axis=1) >= 8 - bits  # count filter on shared positional bytes
            near[near] = _POPCOUNT[diff[near]].sum(axis=1) <= bits  # verified
            if near.any():
                found = rest[near]
                rest = rest[~near]
                members.append(found)
                roots.append(np.full(len(found), root, np.uint64))
                queue.extend(found)
    if not members:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(members), np.concatenate(roots)


def _linked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a list may span batches."""
        held_key, held = None, []

        def done():
            fps = np.concatenate(held).view(np.uint64)
            return forest(fps, bits)

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if held and keys[a] != held_key:
                    if sum(map(len, held)) > 1:
                        out.append(done())
                    held = []
                held_key = keys[a]
                held.append(fps[a:b])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).view(np.int64)) for k in (0, 1)], names=["a", "b"])
        if held and sum(map(len, held)) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in done()], names=["a", "b"])

    return run


def links(distinct: DataFrame, bits: int = BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (column fp) just as all links within reach do."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
    key = lambda n, at: F.lit(n << 56).bitwiseOR(at)
    packed = lambda t: F.shiftleft(byte(t[0]), 16).bitwiseOR(F.shiftleft(byte(t[1]), 8)).bitwiseOR(byte(t[2]))
    keyed = distinct.select("fp", F.explode(F.array(*[key(n, packed(t)) for n, t in enumerate(TRIPLES)])).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1")
    met = keyed.join(sizes, "key")
    triple = F.shiftright("key", 56).cast("int")
    # a fourth position and its byte, as another 11 bits beside the key's 24
    fourth = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(p << 8).bitwiseOR(byte(p)).cast("long").alias("more")) for p in range(8)])
    outside = F.filter(fourth, lambda x: ~F.array_contains(F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in TRIPLES]), triple + 1), x["p"]))
    small = met.where(F.col("count") <= list_limit).select("key", "fp")
    large = met.where(F.col("count") > list_limit).select(F.explode(outside).alias("x"), "key", "fp").select(F.col("key").bitwiseOR(F.shiftleft(F.col("x.more") + 1, 30)).alias("key"), "fp")
    lists = dealt(small.unionByName(large), "key").sortWithinPartitions("key")
    return lists.mapInArrow(_linked(bits), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root for all nodes of edges (a, b), by alternating large-star and small-star; roots are their components' smallest nodes."""
    def marks(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    def star(pairs, low):
        """pairs: (u, v); each v goes to the smallest of u's neighbours and u; low: also u goes there."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = pairs.join(least, "u")
        if low:
            out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    now = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = marks(now)
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = settled(star(both, low=False))
        then = settled(star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), low=True))
        unsettle(now)
        unsettle(large)
        now, last, seen = then, seen, marks(then)
        if seen == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def classes(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, list_limit: int = LIST_LIMIT) -> DataFrame:
    """doc_id, fp, root (the component's key), component_id (its smallest doc_id); a row for each row of docs."""
    prints = settled(fingerprints(docs, shingle))
    distinct = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tree = components(links(distinct, bits, list_limit))
    at = distinct.join(tree, distinct["fp"] == tree["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = at.groupBy("root").agg(F.min("least").alias("component_id"))
    named = at.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(named, prints["fp"] == named["_fp"]).select("doc_id", "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """docs with all their columns, one row of each component: the one with the smallest doc_id, nulls last, then the smallest fingerprint."""
    found = settled(classes(docs, bits, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")
    kept = settled(found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_kept_id"), F.col("k.fp").alias("_kept_fp")))
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
    # a doc_id may stand for several rows: then the fingerprint tells them apart, and equal ones become one
    ids = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_kept_id"))
    if not ids.head(1):
        return out
    many = ids.join(kept, ids["_kept_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
    alone = out.join(many, docs["doc_id"].eqNullSafe(many["_kept_id"]), "left_anti")
    several = out.join(many, docs["doc_id"].eqNullSafe(many["_kept_id"]), "left_semi")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(_fingerprints(as_bytes(batch, "text"), shingle).view(np.int64))
            yield batch.append_column(name, fp)

    name = "_fp" + "_" * max(map(len, several.columns))  # none of docs' own
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in several.schema)
    several = several.mapInArrow(printed, f"{fields}, {name} long")
    several = several.join(kept, several["doc_id"].eqNullSafe(kept["_kept_id"]) & (several[name] == kept["_kept_fp"]), "left_semi").dropDuplicates(["doc_id", name]).drop(name)
    return alone.unionByName(several)
