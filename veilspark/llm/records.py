"""Token IDs in length-delimited binary records, with an offset index for shuffled reads.

A record is

    length  u64   bytes of the payload
    check   u32   masked crc32 of the 8 length bytes
    payload
    check   u32   masked crc32 of the payload

and a payload is flags u8 (1: has a doc_id; 2: ids take 4 bytes, else 2), doc_id i64, ids.
A masked checksum is the crc32 turned right by 15 bits plus 0xa282ead8, so that a
checksum over data that holds checksums stays sound. All numbers are little-endian.
Beside each file PART.rec, PART.idx has for each record its offset u64, bytes u64 and
number of ids u64, so record k of a file can be read alone.

Documents are dealt to tasks by ranges of doc_id and written in ascending order. A task
writes under a name of its own attempt and only the files of tasks that ended are listed
in the manifest, so lost and repeated tasks leave nothing in the dataset. The driver
gets a row for each file. Where a vocabulary drops white space and case and cuts at marks
(checked once), texts are cut at white space, then likewise, and each distinct piece is encoded
once for many documents by the tokenizers library; texts with other than letters beyond ASCII, control
characters or special tokens are encoded whole, as all texts are with other
vocabularies. A test holds this against encoding whole texts.

Defined results: null and empty texts hold the end id alone; null doc_ids come first;
rows with equal doc_ids are ordered by their texts; an empty table gives no files.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, as_list, shared_dir, shuffle_partitions

#: Distinct tokens whose ids a worker keeps; as many older ones stay within reach.
CACHE_PIECES = 500_000
#: Pieces of lower-case text: what some English words end in, letters, a digit, marks.
PIECE = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\x80-\xff]+|[0-9]|[^\x00-\x20\x7fa-z0-9\x80-\xff]+")
CONTROL = bytes([*range(9), *range(14, 32), 127])


class Tokens(dict):
    """Ids of the tokens between white space of lower-case text, each worked out once; None for those with an odd piece, whose texts can't be cut."""

    def __init__(self, tokenizer, kind: str):
        self.tokenizer, self.kind = tokenizer, kind
        self.older: dict[bytes, bytes | None] = {}
        self.pieces: dict[bytes, bytes | None] = {}
        marks = [*"abz09", "hello", "'s", *map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))]
        self.direct = all([t.id for t in tokenizer.model.tokenize(x)] == tokenizer.encode(x, add_special_tokens=False).ids for x in marks)
        self.special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    def fits(tokenizer) -> bool:
        """Whether a vocabulary drops white space and case and cuts texts at least where PIECE does."""
        ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
        text = "ab  Cd7 don't\tWE'LL 's ''s 1984 x--y,z (q!) \u00e9t\u00e9. \u4f60\u597d; #%&* a.b\n$5|c"
        return ids(text) == [i for x in PIECE.findall(text.encode().lower()) for i in ids(x.decode())]

    def plain(self, text: bytes) -> bool:
        return len(text.translate(None, CONTROL)) == len(text) and not any(s in text for s in self.special)

    def __missing__(self, token: bytes) -> bytes | None:
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        if token in self.older:
            got = self.older[token]
        else:
            each = [self._piece(p) for p in PIECE.findall(token)]
            got = None if None in each else b"".join(each)
        self[token] = got
        return got

    def _piece(self, piece: bytes) -> bytes | None:
        if piece not in self.pieces:
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            self.pieces[piece] = self._encoded(piece)
        return self.pieces[piece]

    def _encoded(self, piece: bytes) -> bytes | None:
        text = piece.decode()
        if piece.isascii() and self.direct:  # nothing is left to do but to merge
            return array(self.kind, [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()
        if not piece.isascii() and not (text.isalpha() and text.lower().isalpha()):
            return None
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: bytes) -> bytes | None:
        """Ids of a text; None if it has to be encoded as a whole."""
        if not self.plain(text):
            return None
        try:
            return b"".join(map(self.__getitem__, text.lower().split()))
        except TypeError:  # one of them is None
            return None


_caches: dict[str, tuple[object, Tokens | None, bool]] = {}


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = struct.pack("<Bq", (doc_id is not None) | 2 * wide, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a record; ValueError if it's damaged."""
    if len(record) < 16:
        raise ValueError("a record is cut short")
    (size,), (check,) = struct.unpack_from("<Q", record), struct.unpack_from("<I", record, 8)
    if check != masked(record[:8]) or len(record) != size + 16:
        raise ValueError("a record's length is damaged")
    payload = record[12:-4]
    if struct.unpack("<I", record[-4:])[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return (doc_id if flags & 1 else None), np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


def encode_all(texts: list[bytes], vocabulary: str, end_id: int | None) -> tuple[list[bytes], bool]:
    """Ids of each text, and whether they take 4 bytes."""
    if vocabulary not in _caches:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("H").itemsize != 2 or array("I").itemsize != 4:
            raise RuntimeError("ids are packed in the machine's own order, which must be little-endian")
        new = Tokenizer.from_file(vocabulary)
        large = new.get_vocab_size(with_added_tokens=True) > 1 << 16
        _caches[vocabulary] = (new, Tokens(new, "I" if large else "H") if Tokens.fits(new) else None, large)
    tokenizer, cache, wide = _caches[vocabulary]
    if (end_id or 0) > 0xFFFF and not wide:
        raise ValueError("the end id is beyond the vocabulary")
    kind = "<u4" if wide else "<u2"
    end = b"" if end_id is None else np.array([end_id], kind).tobytes()
    out = [None if cache is None else cache.ids(t) for t in texts]
    whole = [k for k, ids in enumerate(out) if ids is None]
    for at in range(0, len(whole), 256):
        some = whole[at : at + 256]
        for k, e in zip(some, tokenizer.encode_batch_fast([texts[k].decode() for k in some], add_special_tokens=False)):
            out[k] = np.array(e.ids, kind).tobytes()
    return [ids + end for ids in out], wide


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2) -> list[dict]:
    """Writes docs (doc_id, text) under path; returns the manifest, a row for each file, in order: name, n_docs, n_tokens, n_bytes, start (ids before the file)."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{uuid.uuid4().hex}"
        rec, index, n_tokens, at, first = None, [], 0, 0, None
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, wide = encode_all([t or b"" for t in as_bytes(batch, "text")], vocabulary, end_id)
            doc_ids = as_list(batch, "doc_id")
            if rec is None:
                rec, first = fs.open_output_stream(f"{root}/{name}.rec"), batch.column(2)[0].as_py()
            for k in range(0, len(ids), 1000):
                framed = [frame(d, x, wide) for d, x in zip(doc_ids[k : k + 1000], ids[k : k + 1000])]
                rec.write(b"".join(framed))
                for f in framed:
                    n = (len(f) - 25) // (4 if wide else 2)
                    index.append((at, len(f), n))
                    at, n_tokens = at + len(f), n_tokens + n
        if rec is not None:
            rec.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as out:
                out.write(np.array(index, "<u8").tobytes())
            yield pa.RecordBatch.from_pylist([{"name": name, "task": first, "n_docs": len(index), "n_tokens": n_tokens, "n_bytes": at}], schema=pa.schema([("name", pa.string()), ("task", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    pafs_make(path)
    parts = shuffle_partitions(spark)
    # where one doc_id has very many rows, the beginnings of their texts let ranges divide them; whole texts are sorted
    dealt = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    dealt = dealt.withColumn("task", F.spark_partition_id().cast("long"))
    rows = dealt.mapInArrow(run, "name string, task long, n_docs long, n_tokens long, n_bytes long").collect()
    start, manifest = 0, []
    for r in sorted(rows, key=lambda r: r["task"]):
        manifest.append({"name": r["name"], "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "n_bytes": r["n_bytes"], "start": start})
        start += r["n_tokens"]
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(f"{root}/MANIFEST") as out:
        for m in manifest:
            out.write(("\t".join(str(m[k]) for k in ("name", "n_docs", "n_tokens", "n_bytes", "start")) + "\n").encode())
    listed = {f"{m['name']}.{x}" for m in manifest for x in ("rec", "idx")} | {"MANIFEST"}
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.is_file and info.base_name not in listed:  # of attempts that failed
            fs.delete_file(info.path)
    return manifest


def pafs_make(path: str) -> None:
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)


def manifest_of(path: str) -> list[dict]:
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{root}/MANIFEST") as f:
        lines = f.readall().decode().splitlines()
    return [{"name": x[0]} | dict(zip(("n_docs", "n_tokens", "n_bytes", "start"), map(int, x[1:]))) for x in (line.split("\t") for line in lines)]


def read(spark: SparkSession, path: str, with_ids: bool = False, batch_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers) and, if wanted, ids; checksums are verified."""
    files = manifest_of(path)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    kinds = [pa.int64()] * 4
    if with_ids:
        names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int32())]
    schema = pa.schema(list(zip(names, kinds)))
    sql = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not files:
        return spark.createDataFrame([], sql)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start in zip(as_list(batch, "name"), as_list(batch, "start")):
                with fs.open_input_stream(f"{root}/{name}.idx") as f:
                    index = np.frombuffer(f.readall(), "<u8").reshape(-1, 3).astype(np.int64)
                # read in runs of whole records
                cut = np.flatnonzero(np.diff(index[:, 0] // batch_bytes)) + 1
                with fs.open_input_file(f"{root}/{name}.rec") as f:
                    for part in np.split(index, cut):
                        base = int(part[0, 0])
                        data = f.read_at(int(part[-1, 0] + part[-1, 1]) - base, base)
                        cols: list[list] = [[] for _ in names]
                        for at, size, n in part.tolist():
                            doc_id, ids = unframe(data[at - base : at - base + size])
                            if len(ids) != n:
                                raise ValueError("the index doesn't fit its file")
                            row = [doc_id, start, n, zlib.crc32(ids.astype("<u4").tobytes())] + ([ids.astype(np.int32)] if with_ids else [])
                            start += n
                            for c, x in zip(cols, row):
                                c.append(x)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], schema=schema)

    listed = spark.createDataFrame([(m["name"], m["start"]) for m in files], "name string, start long").repartition(len(files))
    return listed.mapInArrow(run, sql)


def read_record(path: str, name: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a file, through the index alone."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(f"{root}/{name}.idx") as f:
        at, size, _ = struct.unpack("<QQQ", f.read_at(24, 24 * k))
    with fs.open_input_file(f"{root}/{name}.rec") as f:
        return unframe(f.read_at(size, at))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_and_read(docs: DataFrame, vocabulary: str | None = None, end_id: int | None = 2) -> DataFrame:
    """The digest of docs as written in the shared folder and read back: doc_id, start, n_tokens, ids_crc32."""
    path = shared_dir(docs.sparkSession)
    write(docs, path, vocabulary or default_vocabulary(), end_id)
    return read(docs.sparkSession, path)
