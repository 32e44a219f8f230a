"""Benchmark decontamination, with DataFrame functions only.

Every item is normalised to words and cut to windows of consecutive words. The
distinct windows make a hash set that is broadcast if its measured size is within
a bound; beyond it the same join is a shuffled one. Each document is read once:
its words are exploded to window positions, a position's hash probes the set in
the same stage, hits are verified word for word, and only hits and one row for
each document reach the shuffle, so neither a hot source nor copies of a document
weigh on a task.

Defined results: null and empty texts have no words and no hits. Repeated rows
give repeated result rows. Rows with a null doc_id are judged like any other. An item
with a null item_id marks words as hit but isn't counted among the items. An empty
benchmark hits nothing. Other columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import ascii_lower

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: For texts whose case is kept.
ANY_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct windows: w_hash, w_text, w_len, w_items (ids of items that hold it)."""
    cut = (
        benchmark.select(F.col("item_id"), words(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))).alias("at"))
        .select("item_id", F.slice("w", F.col("at"), F.lit(n)).alias("win"))
    )
    return (
        cut.groupBy("win")
        .agg(F.collect_set("item_id").alias("w_items"))
        .select(F.xxhash64("win").alias("w_hash"), F.array_join("win", " ").alias("w_text"), F.size("win").alias("w_len"), "w_items")
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text_hash, n_words, marks (sorted distinct (at, len), 1-based), items (distinct ids), copies (equal rows it stands for)."""
    wins = windows(benchmark, n)
    about = wins.groupBy("w_len").agg(F.sum(F.octet_length("w_text") + 64 + 16 * F.size("w_items")).alias("b")).collect()
    lengths = sorted(r["w_len"] for r in about) or [n]  # n values at most
    if sum(r["b"] for r in about) <= broadcast_bytes:
        wins = F.broadcast(wins)
    doc = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("ws"))
    if len(lengths) == 1:
        doc = doc.withColumn("len", F.lit(lengths[0]))
    else:
        doc = doc.withColumn("len", F.explode(F.array(*map(F.lit, lengths))))
    # position 0 stands for the document itself, which stays without any hit
    at = doc.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - F.col("len") + 1, F.lit(0)))))
    at = at.withColumn("h", F.when(F.col("at") > 0, F.xxhash64(F.slice("ws", F.greatest("at", F.lit(1)), F.col("len")))))
    here = F.array_join(F.slice("ws", F.greatest("at", F.lit(1)), F.col("len")), " ")
    # each a prefix of the other: equal, in a form that isn't made a second join key and so isn't worked out for every position
    same = here.startswith(F.col("w_text")) & F.col("w_text").startswith(here)
    joined = (
        at.join(wins, (F.col("h") == F.col("w_hash")) & same, "left")
        .where((F.col("at") == 0) | F.col("w_hash").isNotNull())
        .select("doc_id", "text_hash", F.size("ws").alias("n"), "at", "len", "w_items")
    )
    return (
        joined.groupBy("doc_id", "text_hash")
        .agg(
            F.max("n").alias("n_words"),
            F.array_sort(F.collect_set(F.when(F.col("at") > 0, F.struct("at", "len")))).alias("marks"),
            F.array_distinct(F.flatten(F.collect_set("w_items"))).alias("items"),
            F.sum((F.col("at") == 0).cast("long")).alias("copies"),
        )
        .withColumn("copies", (F.col("copies") / len(lengths)).cast("int"))
    )


def covered(marks: Column) -> Column:
    """Number of words in the union of sorted marks."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, m):
        end = m["at"] + m["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], m["at"]))).alias("n"))

    return F.aggregate(marks, zero, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The digest: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row for each row of docs."""
    hits = find_hits(docs, benchmark, n, broadcast_bytes)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("marks")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("marks") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def without_hits(text: Column, marks: Column) -> Column:
    """text less the marked words; what stands between words stays."""
    gaps, found = F.split(text, ANY_WORD, -1), F.regexp_extract_all(text, F.lit(ANY_WORD), F.lit(0))
    hit = F.transform(found, lambda w, i: F.when(F.exists(marks, lambda m: (i + 1 >= m["at"]) & (i + 1 < m["at"] + m["len"])), F.lit("")).otherwise(w))
    return F.concat(F.element_at(gaps, 1), F.array_join(F.zip_with(hit, F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))), lambda w, g: F.concat(w, g)), ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with all their columns, less documents that hold a window (remove="documents") or less the words of the windows found (remove="spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    hit = find_hits(docs, benchmark, n, broadcast_bytes).where(F.size("marks") > 0).select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"), F.col("marks").alias("_hit_marks"))
    same = docs["doc_id"].eqNullSafe(hit["_hit_id"]) & (F.xxhash64(docs["text"]) == hit["_hit_hash"])
    if remove == "documents":
        return docs.join(hit, same, "left_anti")
    out = docs.join(hit, same, "left")
    text = F.when(hit["_hit_marks"].isNull(), docs["text"]).otherwise(without_hits(docs["text"], hit["_hit_marks"]))
    return out.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
