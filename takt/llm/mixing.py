"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from takt.llm.common import free_name, n_words, numbered, settled

WEIGHTS, TOTAL_SHARE, MOST_REPEATS, BLOCK_WORDS, SHARDS, SEED = (3, 1, 2), 1.5, 2, 16, 16, 77
SLICES = 256


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST_REPEATS) -> np.ndarray:
    """``total`` shared by weight, no share above ``most`` times its size; what is cut off is shared again by
    weight among the rest until none is above."""
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    share, full = np.zeros(len(size)), np.zeros(len(size), bool)
    while not full.all():
        left = total - (most * size[full]).sum()
        share = np.where(full, most * size, max(left, 0.0) * weight / weight[~full].sum())
        above = ~full & (share > most * size)
        if not above.any():
            break
        full |= above
    return np.minimum(share, most * size)


def apportion(wanted: np.ndarray, blocks: int, most: np.ndarray) -> np.ndarray:
    """``blocks`` seats by the highest quotients wanted / (2 k + 1), never more than ``most`` each.

    The k-th seat of a party has the quotient w / (2 k - 1), so a bound on quotients gives all seats above it at
    once: the bound is found by halving, the few seats left by comparing next quotients. Ties: first party.
    """
    w = np.asarray(wanted, float)
    blocks = int(min(blocks, most[w > 0].sum()))
    if blocks <= 0 or not len(w):
        return np.zeros(len(w), np.int64)

    def above(q: float) -> np.ndarray:
        return np.minimum(np.maximum(np.floor((w / q + 1) / 2), 0), np.where(w > 0, most, 0)).astype(np.int64)

    low, high = 1e-12 * w.max() / (blocks + 1), 2 * w.max()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid).sum() > blocks else (low, mid)
    seats = above(high)
    while seats.sum() < blocks:
        quotient = np.where((seats < most) & (w > 0), w / (2 * seats + 1), -1.0)
        seats[int(np.argmax(quotient))] += 1
    return seats


@dataclass(frozen=True)
class Plan:
    """Quotas of a mix. All lists go by source in code point order, NULL last."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    shard_blocks: list[list[int]]
    starts: list[int]


def plan(rows: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_REPEATS,
         block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> Plan:
    """Targets, quotas in blocks of each source and of each shard, and the seeded first word of each source.

    rows has source and size. Only one row a source comes to the driver, as a list of sources is part of the plan.
    """
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in found]
    weight = [float(weights[i % len(weights)]) for i in range(len(found))]
    want = targets(sizes, weight, total_share * sum(sizes), most)
    cap = -(-most * np.asarray(sizes, np.int64) // block_words)  # the last block of a full source may be short
    blocks = int(round(want.sum() / block_words))
    # seats go out in order of quotients: the mix's first shards hold the first seats, each shard its own quota
    upto = [apportion(want, blocks * (s + 1) // shards, cap) for s in range(shards)]
    per_shard = [(b - a).tolist() for a, b in zip([np.zeros(len(want), np.int64), *upto], upto)]
    starts = [int(np.random.default_rng([seed, i]).integers(0, max(n, 1))) for i, n in enumerate(sizes)]
    return Plan([r["source"] for r in found], sizes, want.tolist(), upto[-1].tolist() if shards else [], per_shard, starts)


def mixed(docs: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_REPEATS,
          block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """What the mix takes of every row of docs: doc_id, size, source_size, target, taken, source, begin, full, extra.

    size is the number of words, target the words wanted of the row's source. A source's documents, shuffled by
    a seeded hash, are a ring of words; its quota of equal blocks is taken as one run along the ring from a
    seeded place. A document's words are taken ``full`` times each, and once more from word ``begin`` on,
    ``extra`` of them (round the end to its start); taken = size * full + extra, never over ``most`` times size.
    A source's words taken differ from its target by about a block. Quotas of shards: see ``plan``. Equal texts
    are separate rows; texts without words (NULL, empty) take nothing; a NULL source is a source of its own; an
    empty table gives no row. Reruns give the same result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source"), n_words("text").alias("size"), F.xxhash64("text").alias("content"))
    rows = settled(rows.withColumn("shuffle", F.xxhash64(F.lit(seed), "doc_id", "content")))
    made = plan(rows, weights, total_share, most, block_words, shards, seed)
    table = _plan_table(spark, made, block_words, most)
    sliced = rows.withColumn("slice", F.shiftright("shuffle", 64 - SLICES.bit_length() + 1))
    at = numbered(sliced, ["source"], "slice", ["shuffle", "doc_id", "content"], F.col("size"), "at")
    whole = at.join(table, at["source"].eqNullSafe(table["of_source"]))
    # the run covers ring places [first, first + words): whole rounds, then a rest that may wrap once
    rest, n = F.col("words") % F.greatest("source_size", F.lit(1)), F.col("source_size")
    low, high = F.col("at"), F.col("at") + F.col("size")
    over = lambda a, b: F.greatest(F.lit(0), F.least(high, b) - F.greatest(low, a))
    ahead = over(F.col("first"), F.least(F.col("first") + rest, n))
    wrapped = over(F.lit(0), F.greatest(F.col("first") + rest - n, F.lit(0)))
    return (whole.withColumn("full", F.when(n > 0, F.expr("words div source_size")).otherwise(0).cast("long"))
            .withColumn("extra", (ahead + wrapped).cast("long"))
            .withColumn("begin", F.when(ahead > 0, F.greatest(F.col("first") - low, F.lit(0))).otherwise(0).cast("long"))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("full") + F.col("extra")).alias("taken"),
                    "source", "begin", "full", "extra", "content"))


def _plan_table(spark: SparkSession, made: Plan, block_words: int, most: int) -> DataFrame:
    data = list(zip(made.sources, made.sizes, made.targets, [min(b * block_words, most * n) for b, n in zip(made.blocks, made.sizes)], made.starts))
    return spark.createDataFrame(data, StructType.fromDDL("of_source string, source_size long, target double, words long, first long"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document as many times as it is taken whole, and the taken part of one cut by a run's end.

    Columns are those of docs; n_chars, where there is one, is brought up to date in a cut row. A part is the text
    from the first to the last word taken; a part that wraps round the document's end is two stretches, end first.
    """
    # rows alike in doc_id, source and text share what is taken of them
    taken = mixed(docs, **settings).groupBy("doc_id", "content", "source").agg(
        F.sum("taken").alias("words"), F.max("size").alias("size"), F.min(F.when(F.col("extra") > 0, F.col("begin"))).alias("begin"),
        F.count(F.lit(1)).alias("rows")).select(F.struct("*").alias("__take"))
    content, held, copy = (free_name(docs, n) for n in ("__content", "__take", "__copy"))
    hashed = docs.withColumn(content, F.xxhash64("text"))
    if not taken.where("__take.rows > 1").isEmpty():
        hashed = hashed.dropDuplicates(["doc_id", content, "source"])
    taken = taken.withColumnRenamed("__take", held)
    take = F.col(held)
    same = (hashed["doc_id"].cast("long").eqNullSafe(take["doc_id"]) & hashed["source"].eqNullSafe(take["source"])
            & (hashed[content] == take["content"]))
    # copy 0 is the cut one, where there is one
    copies = F.sequence(F.when(take["words"] % take["size"] > 0, 0).otherwise(1), F.expr(f"{held}.words div {held}.size").cast("int"))
    out = (hashed.join(taken.where(take["words"] > 0), same)
           .select(*[hashed[c] for c in docs.columns], take, F.explode(copies).alias(copy)))
    whole = F.col(copy) > 0
    size = take["size"]
    name = free_name(docs, "__part")
    parts = out.withColumn(name, F.when(whole, F.col("text")).otherwise(
        _stretch("text", F.coalesce(take["begin"], F.lit(0)), take["words"] % size, size)))

    def value(c: str):
        if c == "text":
            return F.col(name).alias("text")
        if c == "n_chars":
            return F.when(whole, F.col(c)).otherwise(F.length(name)).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"`{c}`")
    return parts.select(*[value(c) for c in docs.columns])


def _stretch(text: str, begin, n, size):
    """Words begin .. begin + n of a text with the white space between them; one that wraps goes on at word 0, on a new line."""
    word = r"[^\x20\x09-\x0D]+"
    gaps = F.split(F.col(text), word)
    every = F.regexp_extract_all(F.col(text), F.lit(f"({word})"))
    joined = F.zip_with(every, F.slice(gaps, 2, F.size(every)), lambda w, gap: F.concat(w, F.coalesce(gap, F.lit(""))))
    tail = F.slice(joined, (begin + 1).cast("int"), F.least(n, size - begin).cast("int"))
    head = F.slice(joined, 1, F.greatest(begin + n - size, F.lit(0)).cast("int"))
    joins = F.when(F.size(head) > 0, F.lit("\n")).otherwise("")
    return F.rtrim(F.concat(F.array_join(tail, ""), joins, F.array_join(head, "")))
