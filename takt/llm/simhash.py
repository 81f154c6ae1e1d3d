"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most four bits apart have a common variant at most two flips from each. Every fingerprint
therefore meets all its neighbours in the buckets of its 1 + 64 + 64 * 63 / 2 variants. All members of a bucket
are within two flips of the variant, so within four of each other: a bucket is one class, and linking its members
in a chain loses nothing and lists no pairs.

Variants are shuffled by their leading bits: a fingerprint goes once to each block of variants that it has any in,
and its variants are made where they meet, part by part. There are 64 blocks at least, more with more fingerprints. Blocks with too many fingerprints are
cut by further bits until they hold few or no bits are left.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takt.llm import near_copies
from takt.llm.common import free_name, settled, settled_few
from takt.llm.components import components, local_roots
from takt.llm.near_copies import shingle_hashes

BITS, RADIUS, SHINGLE = 64, 4, 4
BLOCK_PRINTS, AT_ONCE = 150_000, 500_000
FIRST_BITS, STEP_BITS = 6, 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is in over half the XXH64 values (seed 42) of the text's word shingles, repeats included.

    A-Z are lower-cased; fewer words than a shingle are one shingle; no words give 0.
    """
    return print_of(shingle_hashes(text, shingle))


def print_of(made: list[int]) -> int:
    """The fingerprint of a text's shingle values, repeats included."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(made), 1 << 16):  # bounded memory for very long texts
        part = np.array(made[at:at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(made)).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, content, print) of every row: a hash of the text and the fingerprint, both as signed longs."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made)], names=["doc_id", "content", "print"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("content"))
    return rows.mapInArrow(run, "doc_id long, content long, print long")


@lru_cache(maxsize=32)
def masks(bits: int, flips: int) -> np.ndarray:
    """All masks of up to ``flips`` of the lowest ``bits`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)], np.uint64)


def flips_left(used: int) -> Column:
    """Flips that a print may still make below the ``used`` leading bits of the variants of its block."""
    if not used:
        return F.lit(RADIUS // 2)
    return F.lit(RADIUS // 2) - F.bit_count(F.shiftrightunsigned("print", BITS - used).bitwiseXOR(F.col("block")))


def deal(rows: DataFrame, used: int, step: int) -> DataFrame:
    """Rows (block, print) dealt to the finer blocks of ``step`` more leading bits that the print has variants in."""
    moves = F.array(*[F.struct(F.lit(int(m)).cast("long").alias("mask"), F.lit(int(m).bit_count()).alias("cost")) for m in masks(step, RADIUS // 2)])
    own = F.shiftrightunsigned("print", BITS - used - step).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
    return (rows.select("block", "print", own.alias("own"), F.explode(moves).alias("move"))
            .where(F.col("move.cost") <= flips_left(used))
            .select(F.shiftleft("block", step).bitwiseOR(F.col("own").bitwiseXOR(F.col("move.mask"))).alias("block"), "print"))


def meet(prints: np.ndarray, left: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges (i, j) between fingerprints of one block that share a variant of its ``bits`` lowest bits."""
    if not len(prints):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = prints & np.uint64((1 << bits) - 1) if bits < 64 else prints
    made, owner = [], []
    for flips in range(RADIUS // 2 + 1):
        mine = np.flatnonzero(left == flips)
        if len(mine):
            m = masks(bits, flips)
            made.append((low[mine][:, None] ^ m[None, :]).ravel())
            owner.append(np.repeat(mine.astype(np.int32), len(m)))
    variant, who = np.concatenate(made), np.concatenate(owner)
    order = np.argsort(variant)
    variant, who = variant[order], who[order]
    same = np.flatnonzero(variant[1:] == variant[:-1])
    a, b = who[same].astype(np.int64), who[same + 1].astype(np.int64)
    near = np.bitwise_count(prints[a] ^ prints[b]) <= RADIUS  # verified: a bucket's members always are
    pair = np.unique((np.minimum(a, b) * len(prints) + np.maximum(a, b))[near])
    return pair // len(prints), pair % len(prints)


def chains(prints: np.ndarray, left: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``meet`` for any number of prints: many are cut by two more bits at a time, so few variants exist at once."""
    if bits <= 8 or sum(len(masks(bits, f)) * int((left == f).sum()) for f in range(RADIUS // 2 + 1)) <= AT_ONCE:
        return meet(prints, left, bits)
    own = (prints >> np.uint64(bits - 2)) & np.uint64(3)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in range(4):
        rest = left - np.bitwise_count(own ^ np.uint64(part)).astype(np.int64)
        here = np.flatnonzero(rest >= 0)
        i, j = chains(prints[here], rest[here], bits - 2)
        a, b = np.concatenate([a, here[i]]), np.concatenate([b, here[j]])
        if len(a) > AT_ONCE:  # edges within a class say no more than its root does
            root = local_roots(len(prints), a, b)
            a = np.flatnonzero(root != np.arange(len(prints)))
            b = root[a]
    return a, b


def links(prints: DataFrame, block_prints: int = BLOCK_PRINTS) -> DataFrame:
    """(a, b) edges between different fingerprints that connect all that are within RADIUS bits of each other.

    prints holds each fingerprint once, in a column of that name. A block that more than twice ``block_prints``
    are dealt to is cut by further bits, however close its fingerprints are.
    """
    rows = prints.select(F.lit(0).cast("long").alias("block"), "print")
    n, used, edges, step = prints.count(), 0, [], FIRST_BITS
    while n * len(masks(step, RADIUS // 2)) >> step > block_prints and step < 28:
        step += 1
    while True:
        rows = deal(rows, used, step)
        used, step = used + step, STEP_BITS
        if used + 2 * STEP_BITS >= BITS:
            edges.append(edges_of(rows, used))
            break
        crowded = settled(rows.groupBy("block").count().where(F.col("count") > 2 * block_prints).select("block"))
        if crowded.isEmpty():
            edges.append(edges_of(rows, used))
            break
        edges.append(edges_of(rows.join(crowded, "block", "left_anti"), used))
        rows = rows.join(crowded, "block", "left_semi")
    return reduce(DataFrame.unionByName, edges)


def edges_of(rows: DataFrame, used: int) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        prints = part["print"].to_numpy().view(np.uint64)
        block = np.uint64(part["block"].iat[0])
        left = RADIUS // 2 - np.bitwise_count((prints >> np.uint64(BITS - used)) ^ block).astype(np.int64)
        a, b = chains(prints, left, BITS - used)
        root = local_roots(len(prints), a, b)
        hung = np.flatnonzero(root != np.arange(len(prints)))
        signed = part["print"].to_numpy()
        return pd.DataFrame({"a": signed[hung], "b": signed[root[hung]]})

    return rows.groupBy("block").applyInPandas(run, "a long, b long")


def _named(marked: DataFrame) -> DataFrame:
    """(print, component_id) of every fingerprint in marked."""
    prints = settled_few(marked.groupBy("print").agg(F.min("doc_id").alias("first")))
    comps = components(links(prints.select("print")))
    grouped = prints.join(comps, prints["print"] == comps["node"], "left").select(
        "print", "first", F.coalesce("component", "print").alias("component"))
    names = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    return grouped.join(names, "component").select("print", "component", "component_id")


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    fingerprint is 16 lower-case hexadecimal digits; component_id the smallest doc_id reachable over links of at
    most RADIUS differing bits. Equal fingerprints are linked, those of texts without words (0; NULL and empty
    texts too) like any other. Repeated rows are repeated; a NULL doc_id is never a component's name unless all
    of its rows have none. An empty table gives none. Other columns are not read.
    """
    marked = settled(fingerprints(docs, shingle))
    return marked.join(_named(marked), "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _ball_stars(firsts: DataFrame) -> DataFrame:
    """(a, b) pairs of shapes: each text of a component of the fingerprints' balls with the component's smallest shape."""
    prints = settled_few(firsts.select("shape", F.col("first.print").alias("print")))
    comps = components(links(prints.select("print").distinct()))
    grouped = prints.join(comps, prints["print"] == comps["node"], "left").select("shape", F.coalesce("component", "print").alias("component"))
    hubs = grouped.groupBy("component").agg(F.min("shape").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return grouped.join(hubs, "component").where("hub <> shape").select(F.col("hub").alias("a"), F.col("shape").alias("b"))


def keep_first(docs: DataFrame, shingle: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """docs with one row of each component: the one with its smallest doc_id (rows without one come last).

    Links are pairs of texts whose sets of ``shingle``-word shingles have at least that Jaccard similarity. Ball hashing of
    their fingerprints brings the nearest texts together, each pair that it names is checked on the whole sets, and what a ball of
    RADIUS bits doesn't reach is found by ``near_copies``. All columns stay. Of rows with equal doc_id and component the one with the smallest text hash stays, of rows
    equal in both any one. Empty and NULL texts are one component.
    """
    marked = near_copies.marked(docs, shingle, lambda made: int(np.uint64(print_of(made)).view(np.int64)))
    firsts = settled_few(near_copies.first_rows(marked))
    found = near_copies.near_components(docs, marked, firsts, shingle, similarity, _ball_stars(firsts))
    kept = (firsts.join(found, firsts["shape"] == found["node"], "left").groupBy(F.coalesce("component", "shape").alias("class"))
            .agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("at_doc"), F.col("first.content").alias("at_content")))
    out = docs.join(kept, near_copies.same_row(docs, kept), "left_semi")
    repeated = marked.groupBy("doc_id", "content").count().where("count > 1")
    if repeated.isEmpty():
        return out
    content = free_name(docs, "__content")
    return out.withColumn(content, F.xxhash64("text")).dropDuplicates(["doc_id", content]).drop(content)
