"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix has `share` times the words of all documents. Sources, in code point order with
null last, weigh `weights` in turn; a source's target stops at `repeats` times its size
and the excess is shared again by weight until no target is above. The mix is then dealt
out in blocks of equally many words: a source's k-th block has the quotient
target / (2 k + 1), and the highest quotients get the blocks. A source's integer quota is
apportioned again, by the same rule, to its shards. A shard is a bounded number of its
documents, in an order given by a seeded hash, laid end to end and cut to blocks. Of a
shard's n blocks, a quota q takes each q div n times, and q mod n seeded ones once more.

A large source has many shards, so none is a task's whole work, and blocks are worked out
by arithmetic on positions, never made rows. The driver holds a row for each source and
each shard, of which there are at most SHARDS and one for each source.

Defined results: null and empty texts have size 0 and take 0. Repeated rows are
documents of their own and may differ by where they lie; the multiset of results is the
same in every run. A source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.common import settled

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SEED = 16, 7
#: A shard has about SHARD_DOCS documents, or more if there would be over SHARDS shards.
SHARD_DOCS, SHARDS = 1_000, 100_000
BROADCAST_ROWS = 100_000
#: Words: maximal runs of characters other than these.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> list[float]:
    """Targets of sources in order."""
    total, n = share * sum(sizes), len(sizes)
    weight = [weights[k % len(weights)] for k in range(n)]
    out = [0.0] * n
    free, left = set(range(n)), total
    while free:
        unit = left / sum(weight[k] for k in free)
        over = {k for k in free if unit * weight[k] > repeats * sizes[k]}
        if not over:
            for k in free:
                out[k] = unit * weight[k]
            break
        for k in over:
            out[k] = float(repeats * sizes[k])
        free -= over
        left = total - sum(out[k] for k in range(n) if k not in free)
    return out


def sainte_lague(seats: int, votes: list[float], caps: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1); ties go to the earlier party; a party's seats stop at its cap."""
    seats = min(seats, sum(c for v, c in zip(votes, caps) if v > 0))

    def at(limit: float) -> list[int]:
        """Seats of each party whose quotients are above the limit."""
        return [0 if v <= 0 else min(c, bisect.bisect_left(range(c), True, key=lambda k: not v / (2 * k + 1) > limit)) for v, c in zip(votes, caps)]

    low, high = 0.0, max(votes, default=0.0)
    for _ in range(100):  # the limit that all the seats but a few are above
        mid = (low + high) / 2
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    out = at(high)
    heap = [(-v / (2 * k + 1), n) for n, (v, c, k) in enumerate(zip(votes, caps, out)) if v > 0 and k < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, n = heapq.heappop(heap)
        out[n] += 1
        if out[n] < caps[n]:
            heapq.heappush(heap, (-votes[n] / (2 * out[n] + 1), n))
    return out


def block_words(sizes: list[int], most: int = BLOCK_WORDS) -> int:
    """Words in a block: fewer than `most` where the smallest source that isn't empty has less than 64 blocks."""
    return max(1, min([most, *(s // 64 for s in sizes if s)]))


def div(a: Column, b: Column) -> Column:
    """Whole division of longs."""
    return F.call_function("div", a, b)


def seeded(seed: int, *parts: Column) -> Column:
    """32 hex digits that follow from the seed and the parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def number(draw: Column) -> Column:
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")


def taken_before(x: Column, q: Column, n: Column, block: Column, chosen: Column) -> Column:
    """Words taken of a shard's first x words; q: the quota, n: blocks in the shard, chosen: the seeded start in 0 .. n - 1."""
    more = q % n
    j = div(x, block)
    before = div(j * more + chosen, n)
    here = div((j + 1) * more + chosen, n) - before
    return div(q, n) * x + before * block + here * (x - j * block)


def plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS, most=BLOCK_WORDS, shard_docs=SHARD_DOCS, seed=SEED) -> DataFrame:
    """A row for each row of docs: doc_id, draw, size, source_size, target, start (words before it in its shard), quota, blocks, chosen (seeded start), block, taken."""
    spark = docs.sparkSession
    sized = settled(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), seeded(seed, F.col("doc_id"), F.col("text")).alias("draw")))
    about = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    rows = sorted(((r["source"], r["rows"], r["size"]) for r in about.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [r[2] for r in rows]
    goal = targets(sizes, weights, share, repeats)
    block = block_words(sizes, most)
    in_shard = max(shard_docs, math.ceil(sum(r[1] for r in rows) / SHARDS))
    shards = [max(1, math.ceil(r[1] / in_shard)) for r in rows]
    names = spark.createDataFrame([(r[0], k, n) for k, (r, n) in enumerate(zip(rows, shards))], "_source string, rank int, shards int")
    # seeded again: the order within a shard must not follow from the choice of the shard
    dealt = (
        sized.join(F.broadcast(names) if len(rows) <= BROADCAST_ROWS else names, sized["source"].eqNullSafe(names["_source"]))
        .withColumn("shard", (number(seeded(seed, F.col("draw"))) % F.col("shards")).cast("int"))
        .drop("_source")
    )
    held: list[dict[int, int]] = [{} for _ in rows]
    for r in dealt.groupBy("rank", "shard").agg(F.sum("size").alias("words")).collect():
        held[r["rank"]][r["shard"]] = r["words"]
    blocks = [{s: math.ceil(w / block) for s, w in h.items()} for h in held]
    seats = sainte_lague(math.floor(sum(goal) / block + 0.5), goal, [repeats * sum(b.values()) for b in blocks])
    quotas = []
    for k, (h, b, q) in enumerate(zip(held, blocks, seats)):
        order = sorted(h)
        quotas += [(k, s, got, b[s], sizes[k], goal[k]) for s, got in zip(order, sainte_lague(q, [float(h[s]) for s in order], [repeats * b[s] for s in order]))]
    quota = spark.createDataFrame(quotas, "_rank int, _shard int, quota long, blocks long, source_size long, target double")
    quota = F.broadcast(quota) if len(quotas) <= BROADCAST_ROWS else quota
    before = Window.partitionBy("rank", "shard").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
    full = laid.join(quota, (laid["rank"] == quota["_rank"]) & (laid["shard"] == quota["_shard"])).where("blocks > 0").withColumn("block", F.lit(block).cast("long"))
    full = full.withColumn("chosen", number(seeded(seed, F.col("rank"), F.col("shard"))) % F.col("blocks"))
    upto = lambda x: taken_before(x, F.col("quota"), F.col("blocks"), F.col("block"), F.col("chosen"))
    full = full.withColumn("taken", upto(F.col("start") + F.col("size")) - upto(F.col("start")))
    # shards without any word have no blocks
    none = laid.join(quota, (laid["rank"] == quota["_rank"]) & (laid["shard"] == quota["_shard"])).where("blocks = 0")
    none = none.select(*[F.col(c) if c in none.columns else F.lit(0).cast("long").alias(c) for c in full.columns])
    return full.unionByName(none).drop("_rank", "_shard", "shards", "source")


def report(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """docs with all their columns, as the mix takes them: a row for the words that it takes at least once, another for those it takes twice, and so on.

    A row's text runs over the words taken, with the white space that follows each in the text;
    a document of which nothing is taken is left out.
    """
    seed = settings.get("seed", SEED)
    times = plan(docs, **settings).where("taken > 0").select(F.col("doc_id").alias("_doc_id"), F.col("draw").alias("_times_draw"), "start", "quota", "blocks", "chosen", "block")
    # equal rows are told apart by a number, so that each has the place of one of them
    times = times.withColumn("_times_nth", F.row_number().over(Window.partitionBy("_doc_id", "_times_draw").orderBy("start")))
    # docs' columns travel in one struct, so that none of their names matters
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), seeded(seed, F.col("doc_id"), F.col("text")).alias("draw"))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("row.doc_id", "draw").orderBy("draw")))
    both = own.join(times, F.col("row.doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("draw") == F.col("_times_draw")) & (F.col("nth") == F.col("_times_nth")))
    every, more = div(F.col("quota"), F.col("blocks")), F.col("quota") % F.col("blocks")
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1), (every + (more > 0).cast("long")).cast("int"))))
    words = F.regexp_extract_all("row.text", F.lit(WORD + SPACE[:-1] + "*"), F.lit(0))

    def chosen(i: Column) -> Column:
        j = div(F.col("start") + i, F.col("block"))
        return div((j + 1) * more + F.col("chosen"), F.col("blocks")) > div(j * more + F.col("chosen"), F.col("blocks"))

    part = F.array_join(F.filter(words, lambda w, i: chosen(i)), "")
    out = each.withColumn("mixed", F.when(F.col("copy") <= every, F.col("row.text")).otherwise(part)).where("mixed <> ''")
    return out.select(*[F.col("mixed").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
