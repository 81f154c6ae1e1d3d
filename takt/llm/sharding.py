"""Sharding by proportional stratified interleaving."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takt.llm.common import numbered, settled

SHARDS, SEED = 16, 20_240_601
SLICES = 1024


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """Every row of docs with its place in one of ``shards`` shards; the law is `rows`.

    Rows of a source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank + 1/2) / rows of
    its source. All rows are sorted by fractional rank (equal ones by hash) and cut into shards whose row counts
    differ by one at most, so each shard holds every source in its share of the whole, within two rows.

    Returns doc_id, size (UTF-8 bytes of the text, none for NULL, plus 1), text_crc32 (of an empty text for
    NULL), law, shard, slot (place in the shard, gapless from 0), grown_shard (NULL: only the law `key` has one)
    and source. A NULL source is a source of its own. Repeated rows each get a place; rows alike in all columns
    may swap theirs. An empty table gives no row. Both ranks are cut into hash slices, so neither a source nor
    a shard is ever sorted in one task.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = settled(rows.withColumn("shuffle", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")))
    sliced = rows.withColumn("slice", F.shiftright("shuffle", 64 - slices.bit_length() + 1))
    tie = ["shuffle", "doc_id", "text_crc32", "size"]
    ranked = numbered(sliced, ["source"], "slice", tie, name="rank")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("of_source"))
    total = rows.count()
    fraction = ((2 * F.col("rank") + 1) / (2 * F.col("of_source"))).alias("fraction")
    placed = ranked.join(counts, ranked["source"].eqNullSafe(counts["source"])).select(
        *[ranked[c] for c in rows.columns], fraction).withColumn("part", F.floor(F.col("fraction") * slices))
    placed = numbered(placed.withColumn("all", F.lit(0)), ["all"], "part", ["fraction", *tie, "source"], name="place")
    # shard s takes the places from ceil(s * total / shards) on
    shard = F.expr(f"(place * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (placed.withColumn("shard", shard.cast("int"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source"))
