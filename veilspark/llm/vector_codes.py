"""Vector codes: each vector is cut into parts, and each part stands as the number of the nearest entry of its codebook.

Components are integers, floor(256 x), so distances, sums and codebooks are exact and the same on every run. The entries
of a part are kept in a vantage-point tree: an entry, the entries nearer to it and those farther away, each half with
the least and greatest distance from it. Nearest entries are searched for all vectors of a batch at once, by branch and
bound: half a tree is left out only if its bound, rounded down, exceeds the best distance so far, rounded up, so
that equally near entries are visited and the one of the lower index wins. The distances that decide are integers.

A round assigns all vectors and replaces entries by their parts' means. Tasks add their parts up first, so a round
shuffles a row for each entry, component and task, whatever the vectors; sums are sent in limbs, so they can't overflow.

Vectors that are null, or hold null, non-finite or larger components than a float's, are dropped, and so are those whose
length isn't a positive multiple of the number of parts, or differs from that of the kept row of least vec_id. Fewer rows than
entries make smaller codebooks; an empty table gives no rows. Rows of one vec_id are ordered by their vectors, null ids
come last. Errors beyond 64 bits are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import settled

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
FLOAT_MAX = 3.4028234663852886e38
#: Entries of a part of the tree that are compared one by one.
LEAF = 8
LIMB = 40
BROADCAST_LABELS = 100_000
_SLACK = 1e-15


def _root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


def _squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances to an entry, exactly: int64, or Python's integers if points or entries are such."""
    gap = points - entry
    return (gap * gap).sum(axis=1)


@dataclass
class Node:
    """The entry `at`, and the halves of the others by distance from it, with their least and greatest distances (rounded down and up); a leaf has its entries alone."""

    entries: list[int]
    at: int = -1
    halves: tuple[tuple[Node, float, float], ...] = ()


def tree(book: np.ndarray, entries: list[int] | None = None) -> Node:
    entries = list(range(len(book))) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(sorted(entries))
    at, rest = entries[0], entries[1:]
    d2 = _squares(book[rest], book[at])
    order = sorted(range(len(rest)), key=lambda k: d2[k])
    halves = []
    for part in (order[: len(order) // 2], order[len(order) // 2 :]):
        far = _root(d2[part])
        halves.append((tree(book, [rest[k] for k in part]), float(far.min()) * (1 - _SLACK), float(far.max()) * (1 + _SLACK)))
    return Node([at], at, tuple(halves))


def nearest(points: np.ndarray, book: np.ndarray, root: Node) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry; the lowest index of equally near ones."""
    index = np.full(len(points), -1, np.int64)
    best = np.zeros(len(points), points.dtype)  # what's not met yet has no index

    def meet(rows: np.ndarray, entries: list[int]) -> np.ndarray:
        """Distances to entries, in ascending order, and what's nearer so far put down."""
        gap = points[rows, None] - book[entries]
        d2 = (gap * gap).sum(axis=2)
        which = d2.argmin(axis=1)
        least, k = d2[np.arange(len(rows)), which], np.array(entries)[which]
        better = (index[rows] < 0) | (least < best[rows]) | ((least == best[rows]) & (k < index[rows]))
        index[rows[better]], best[rows[better]] = k[better], least[better]
        return d2

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not node.halves:
            meet(rows, node.entries)
            return
        away = _root(meet(rows, [node.at])[:, 0])
        # what each half holds at the least from a point, rounded down
        least = [np.maximum(away * (1 - _SLACK) - hi, lo - away * (1 + _SLACK)) * (1 - _SLACK) for _, lo, hi in node.halves]
        inner = least[0] <= least[1]
        for first, here in ((0, np.flatnonzero(inner)), (1, np.flatnonzero(~inner))):
            for half in (first, 1 - first):
                bound = _root(best[rows[here]]) * (1 + _SLACK)
                visit(node.halves[half][0], rows[here[least[half][here] <= bound]])

    visit(root, np.arange(len(points)))
    return index, best


class Books:
    """The codebooks of all parts: integers by part, entry and place."""

    def __init__(self, books: np.ndarray):
        parts, _, width = books.shape
        #: Components up to this make distances that 64 bits hold.
        self.small = int((2**60 / (parts * width)) ** 0.5)
        self.exact = books.astype(object)
        self.fits = bool((abs(self.exact) <= self.small).all())
        self.books = books.astype(np.int64) if self.fits else self.exact
        self.trees = [tree(b) for b in self.books]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances of parts of integer vectors; Python's integers in, where 64 bits won't do."""
        parts = vectors.reshape(len(vectors), *self.books.shape[::2])
        exact = vectors.dtype == object
        books = self.exact if exact else self.books
        each = [nearest(np.ascontiguousarray(parts[:, k]) if self.fits or exact else parts[:, k].astype(object), books[k], t) for k, t in enumerate(self.trees)]
        return np.stack([i for i, _ in each], 1), np.stack([d for _, d in each], 1)


def integers(batch: pa.Array, small: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their integer vectors, floor(256 x): those of 64 bits, then others as Python's integers."""
    n = len(batch)
    x = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    scaled = np.floor(x * SCALE)
    fits = (np.abs(scaled) <= small).all(axis=1)
    if fits.any():
        yield np.flatnonzero(fits), scaled[fits].astype(np.int64)
    if not fits.all():
        yield np.flatnonzero(~fits), np.array([[int(v) for v in row] for row in scaled[~fits].tolist()], object)


def usable(df: DataFrame, vector: str = "embedding", parts: int = PARTS) -> tuple[DataFrame, int]:
    """Rows whose vectors can be coded, and how long these are (0 without any)."""
    v = F.col(vector)
    size = F.size(v)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= FLOAT_MAX))
    kept = df.where(v.isNotNull() & (size > 0) & (size % parts == 0) & fine)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), vector).select(size.alias("n")).first()
    return (kept.where(size == first["n"]), first["n"]) if first else (kept, 0)


def _limbs(value: int) -> list[tuple[int, int]]:
    """A number as signed limbs of LIMB bits; sums of limbs are the limbs of the sum."""
    out, sign, value, k = [], -1 if value < 0 else 1, abs(value), 0
    while value:
        if low := value & ((1 << LIMB) - 1):
            out.append((k, sign * low))
        value >>= LIMB
        k += 1
    return out


_SUM = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("v", pa.int64())])


def better_books(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round. kept: embedding."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Books(books)
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, vectors in integers(batch.column(0), made.small):
                codes, _ = made.assign(vectors)
                cut = vectors.reshape(len(vectors), parts, width)
                for k in range(parts):
                    order = np.argsort(codes[:, k], kind="stable")
                    met, first, n = np.unique(codes[order, k], return_index=True, return_counts=True)
                    sums[k, met] += np.add.reduceat(cut[order, k], first, axis=0).astype(object)
                    counts[k, met] += n
        rows = [(k, e, -1, 0, int(counts[k, e])) for k, e in zip(*np.nonzero(counts))]
        rows += [(k, e, d, limb, v) for k, e, d in np.ndindex(parts, entries, width) for limb, v in _limbs(int(sums[k, e, d]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUM)], schema=_SUM)

    made = kept.select("embedding").mapInArrow(run, "part int, entry int, at int, limb int, v long")
    out, counts = np.zeros(books.shape, object), np.zeros((parts, entries), object)
    for r in made.groupBy("part", "entry", "at", "limb").agg(F.sum("v").alias("v")).collect():  # entries x (length + 1) rows, times a few limbs
        if r["at"] < 0:
            counts[r["part"], r["entry"]] = r["v"]
        else:
            out[r["part"], r["entry"], r["at"]] += r["v"] << (LIMB * r["limb"])
    for k, e in np.ndindex(parts, entries):
        out[k, e] = [x // counts[k, e] for x in out[k, e]] if counts[k, e] else books[k, e]
    return out


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks, from the parts of the rows of least vec_id. kept: of usable()."""
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.col("embedding").cast("array<double>").alias("v")).limit(entries).collect()
    whole = np.array([[int(x) for x in np.floor(np.array(r["v"]) * SCALE).tolist()] for r in seeds], object)
    books = whole.reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = better_books(kept, books)
    return books


def encode(kept: DataFrame, books: np.ndarray, *keep: str) -> DataFrame:
    """The columns named, code (an array of entries' numbers, one for each part) and error of each row."""
    fields = [kept.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Books(books)
        for batch in batches:
            codes = np.zeros((len(batch), len(books)), np.int32)
            errors: list = [None] * len(batch)
            for rows, vectors in integers(batch.column(len(keep)), made.small) if len(batch) else ():
                codes[rows], far = made.assign(vectors)
                for row, total in zip(rows.tolist(), far.sum(axis=1).tolist()):
                    errors[row] = total if total < 1 << 63 else None
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(books)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], code, pa.array(errors, pa.int64())], names=[*keep, "code", "error"])

    return kept.select(*keep, "embedding").mapInArrow(run, schema)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def hexed(code: Column) -> Column:
    return F.array_join(F.transform(code, lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")


def report(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (summed over equal labels) and the codebooks' digest."""
    kept, n = usable(vectors.select("vec_id", "label", F.col("embedding")), parts=parts)
    if not n:
        empty = np.zeros((parts, 0, 0), object)
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(books_digest(empty)).alias("codebooks_sha256"))
    books = fit(kept, parts, entries, rounds)
    coded = settled(encode(kept, books, "vec_id", "label"))
    # a null error (beyond 64 bits) makes its label's sum null as well
    sums = coded.groupBy("label").agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error")
    few = sums.count() <= broadcast_labels
    both = coded.join(F.broadcast(sums) if few else sums, coded["label"].eqNullSafe(sums["_label"]))
    return both.select("vec_id", hexed(F.col("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
