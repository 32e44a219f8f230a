r"""Lines that many documents share are kept in one of them only.

A text is split at \n; a line's key is the line without white space [\x20\x09-\x0D] at its ends, A-Z in
lower case. Keys of at least `min_chars` code points that are found in at least `min_docs` documents
lose all their lines but those of the largest doc_id that holds them.

Three passes go over the texts and hardly anything else leaves them. The first fills two Bloom filters in
each task: of keys met once, and of keys met again; merged, a key's bits are in the second one if any two
documents hold it. The second pass sends just the keys that this filter suspects, as SHA-256 digests, to be
counted: most lines of a corpus are in one document and never move. The third drops lines. The filters only
save shuffling: whatever they suspect wrongly is counted and found to be fine, and they never miss a repeat.

Null and empty texts are one empty line. Each row counts as a document; repeated rows of one doc_id that is the
largest all keep a line. A null doc_id is smaller than any other; where a key has none but nulls, its
lines stay. Empty tables give no rows; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import as_list, dealt, settled
from veilspark.llm.repeats import keyed

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Bits of a filter: a bit for each byte of the table, within these bounds. A filter that's too small suspects more; the result stays.
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 30
#: 64-bit words in a row of a filter that's sent to be merged.
SEGMENT = 1 << 12
#: Keys that may be broadcast, of 32 bytes and a doc_id each.
BROADCAST_KEYS = 200_000


@dataclass
class Lines:
    """The lines of a batch of texts: each one's text (row), and for those that are long enough their number, key and key's hash."""

    #: Where each text's lines begin, and one more.
    starts: np.ndarray
    flat: pa.Array
    long: np.ndarray
    row: np.ndarray
    keys: list[bytes]
    hashes: np.ndarray


def split_lines(texts: pa.Array, min_chars: int) -> Lines:
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    flat = split.flatten()
    starts = split.offsets.to_numpy() - split.offsets[0].as_py()
    keys = pc.ascii_lower(pc.ascii_trim(flat, characters=SPACE))
    enough = pc.greater_equal(pc.utf8_length(keys), min_chars)
    long = np.flatnonzero(enough.to_numpy(zero_copy_only=False))
    held = keys.filter(enough).cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, held), np.uint64, len(held))
    return Lines(starts, flat, long, np.searchsorted(starts, long, "right") - 1, held, hashes)


def places(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's word in a filter of a power of two of words, and its four bits there."""
    one, six = np.uint64(1), np.uint64(63)
    mask = one << (h & six)
    for k in (6, 12, 18):
        mask |= one << ((h >> np.uint64(k)) & six)
    return ((h >> np.uint64(24)) & np.uint64(words - 1)).astype(np.int64), mask


class Filters:
    """Of keys met, and of keys met in two documents or more."""

    def __init__(self, bits: int):
        self.once, self.twice = np.zeros(bits >> 6, np.uint64), np.zeros(bits >> 6, np.uint64)

    def add(self, row: np.ndarray, h: np.ndarray) -> None:
        """Hashes of the keys of documents; a document counts a key once."""
        order = np.lexsort((row, h))
        row, h = row[order], h[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, bool)
        h, n = np.unique(h[new], return_counts=True)
        at, mask = places(h, len(self.once))
        again = (n > 1) | ((self.once[at] & mask) == mask)
        np.bitwise_or.at(self.twice, at[again], mask[again])
        np.bitwise_or.at(self.once, at, mask)

    def rows(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """What isn't zero, by segment: words' places, and the words of both filters."""
        at = np.flatnonzero(self.once)
        cut = np.searchsorted(at, np.arange(0, len(self.once) + SEGMENT, SEGMENT))
        for k in range(len(cut) - 1):
            here = at[cut[k] : cut[k + 1]]
            if len(here):
                yield k, (here - k * SEGMENT).astype(np.uint16).tobytes(), self.once[here].tobytes(), self.twice[here].tobytes()


def suspects(h: np.ndarray, twice: np.ndarray) -> np.ndarray:
    at, mask = places(h, len(twice))
    return (twice[at] & mask) == mask


def filter_bits(docs: DataFrame) -> int:
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 55 else 0  # Spark has no figure
    return min(max(1 << (size - 1).bit_length() if size else 0, LEAST_BITS), MOST_BITS)


_ROWS = pa.schema([("segment", pa.int32()), ("at", pa.binary()), ("once", pa.binary()), ("twice", pa.binary())])


def twice_met(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The filter of keys that two documents or more hold; at most MOST_BITS come to the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(bits)
        for batch in batches:
            lines = split_lines(batch.column(0), min_chars)
            own.add(lines.row, lines.hashes)
        for row in own.rows():
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ROWS)], schema=_ROWS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "twice": pa.array([twice.tobytes()], pa.binary())})

        now = once = twice = None
        for batch in batches:
            for k, at, o, t in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    if now is not None:
                        yield out()
                    now, once, twice = k, np.zeros(SEGMENT, np.uint64), np.zeros(SEGMENT, np.uint64)
                at, o, t = np.frombuffer(at, np.uint16), np.frombuffer(o, np.uint64), np.frombuffer(t, np.uint64)
                twice[at] |= t | (once[at] & o)
                once[at] |= o
        if now is not None:
            yield out()

    made = docs.select("text").mapInArrow(fill, "segment int, at binary, once binary, twice binary")
    merged = dealt(made, "segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    twice = np.zeros(bits >> 6, np.uint64)
    for r in merged.toLocalIterator():
        twice[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["twice"], np.uint64)
    return twice


def _met(lines: Lines, twice: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Text, line and key's digest of the lines that the filter suspects."""
    for k in np.flatnonzero(suspects(lines.hashes, twice)).tolist():
        yield int(lines.row[k]), int(lines.long[k]), hashlib.sha256(lines.keys[k]).digest()


def shared_keys(docs: DataFrame, spread, min_chars: int, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """digest, last of keys that at least min_docs documents hold, and doc_id, th, digest of all suspected ones. spread: the broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = split_lines(batch.column(2), min_chars)
            met = dict.fromkeys((row, digest) for row, _, digest in _met(lines, spread.value))
            if met:
                rows = pa.array([r for r, _ in met], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([d for _, d in met], pa.binary())], names=["doc_id", "th", "digest"])

    found = docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, digest binary")
    return found.groupBy("digest").agg(F.count("*").alias("_n"), F.max("doc_id").alias("last")).where(F.col("_n") >= min_docs).select("digest", "last"), found


def _dropped(lines: Lines, ids: list, twice: np.ndarray, last_of: Callable[[int], dict]) -> np.ndarray:
    """Whether each line goes. last_of: a text's number to the last doc_id by digest."""
    gone = np.zeros(len(lines.flat), bool)
    for row, line, digest in _met(lines, twice):
        last = last_of(row)
        gone[line] = digest in last and last[digest] is not None and last[digest] != ids[row]
    return gone


def cleaned(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS, digests: bool = False) -> DataFrame:
    """docs (doc_id, th, text and a struct `row`) as doc_id, n_lines, n_dropped, kept (text, or its digest in hex) and row.

    Keys to drop are broadcast up to `broadcast_keys`; more of them are joined with the suspected
    lines and dealt to their documents.
    """
    spark = docs.sparkSession
    bits = bits or filter_bits(docs)
    spread = spark.sparkContext.broadcast(twice_met(docs, bits, min_chars))
    confirmed, found = shared_keys(docs, spread, min_chars, min_docs)
    confirmed = settled(confirmed)
    if confirmed.count() <= broadcast_keys:
        table = spark.sparkContext.broadcast({bytes(r["digest"]): r["last"] for r in confirmed.toLocalIterator()})
        sent = docs.select("doc_id", "text", "row")
    else:
        table = None
        of = found.join(confirmed, "digest").groupBy("doc_id", "th").agg(F.collect_set(F.struct("digest", "last")).alias("_gone"))
        of = of.select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), "_gone")
        sent = docs.join(of, docs["doc_id"].eqNullSafe(of["_doc_id"]) & (docs["th"] == of["_th"]), "left").select("doc_id", "text", "row", "_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = as_list(batch, "doc_id"), split_lines(batch.column(1), min_chars)
            if table is not None:
                gone = _dropped(lines, ids, spread.value, lambda _: table.value)
            else:
                each = [{x["digest"]: x["last"] for x in g or ()} for g in as_list(batch, "_gone")]
                gone = _dropped(lines, ids, spread.value, each.__getitem__)
            counts = np.add.reduceat(gone, lines.starts[:-1], dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
            left = lines.flat.filter(pa.array(~gone))
            ends = np.concatenate(([0], np.cumsum(np.diff(lines.starts) - counts)))
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), left), "\n")
            if digests:
                kept = pa.array([hashlib.sha256(t).hexdigest() for t in kept.cast(pa.binary()).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(lines.starts), pa.int64()), pa.array(counts), kept, batch.column(2)], names=["doc_id", "n_lines", "n_dropped", "kept", "row"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType()), docs.schema["row"]])
    return sent.mapInArrow(run, schema)


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the same columns, repeated lines gone from their text; a null text becomes empty."""
    # columns by number, since names may be odd or differ by case alone
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    out = cleaned(keyed(docs, packed.alias("row")), min_chars, min_docs)
    return out.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept_sha256 of the lines that stay, joined by \\n."""
    return cleaned(keyed(docs, F.lit(None).cast("byte").alias("row")), min_chars, min_docs, bits, broadcast_keys, digests=True).select("doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))
