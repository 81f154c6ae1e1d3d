"""Near copies by exact Jaccard similarity of word shingles.

The fingerprints' balls (``simhash``) name the nearest texts, which are checked first. Texts at the limit of similarity differ in far more
bits of a 64-bit fingerprint than a ball of few flips reaches, so further candidates come from MinHash bands: a pair of similarity s shares a band of ROWS minima with chance s ** ROWS, and
misses all BANDS of them with chance (1 - s ** ROWS) ** BANDS (3e-6 at 0.8). Every link is then verified on the
whole shingle sets.

Equal sets are one node. A bucket is first linked as a star around the node that shares most buckets, which settles groups of near
copies of one text without listing their pairs. Texts that share a bucket with another class after that may be alike or may only have a
passage in common. They go through an exact join on rare shingles: in any total order, two sets of similarity t share one of the first
n - ceil(t n) + 1 shingles of the one and one of the first n - ceil(2 t / (1 + t) n) + 1 of the smaller one. With rare shingles first, a
passage that many texts share is no key unless nearly the whole text consists of it.

In that join the texts linked to one hub are one row a key, with bounds of their sizes and bitmaps. One less Jaccard similarity is a metric: of
two hubs' texts only those far enough from their hubs to make up for the hubs' distance are paired, so a text that a large group
shares a passage with is checked against the group's hub, not against all of the group.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takt.llm.common import few_tasks, hashed_share, settled, settled_few
from takt.llm.components import components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 24, 4
AT_ONCE = 1 << 12
WORDS, SETS_AT_ONCE = 8, 256  # longs of a set's bitmap; sets in work at a time
SETS_A_TASK = 500  # a long text has 20,000 shingles
SAMPLE, MOST, LEAST = 5_000, 1 << 18, 3  # texts that the order is learned from, shingles it keeps, texts a common one is in
MULTIPLIERS = np.random.default_rng(SEED).integers(1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 values (seed 42) of the text's word shingles, repeats included.

    A-Z are lower-cased; fewer words than a shingle are one shingle; no words give none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return []
    k = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingle hashes of a text, ascending."""
    return _different(shingle_hashes(text, shingle))


def _different(made: list[int]) -> np.ndarray:
    return np.unique(np.array(made, np.uint64))


def bands(made: np.ndarray) -> np.ndarray:
    """One key a band of a set's minima; an empty set has none."""
    if not len(made):
        return np.zeros(0, np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(made), AT_ONCE):  # bounded memory for very long texts
        part = made[at:at + AT_ONCE, None] ^ MULTIPLIERS[0]
        low = np.minimum(low, ((part ^ (part >> np.uint64(31))) * MULTIPLIERS[1]).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


class Order:
    """A total order of shingles, rare ones first, and the parts of a set that it makes responsible for pairs.

    Frequencies come from a bounded sample of texts; what is in few or none of them stands in the order of its hash. The order decides only how
    many texts meet, not which pairs are found.
    """

    def __init__(self, common: np.ndarray, counts: np.ndarray, similarity: float):
        at = np.argsort(common)
        self.common, self.counts = common[at], counts[at]
        t = Fraction(similarity).limit_denominator(1000)
        self.t, self.both = t, 2 * t / (1 + t)

    def lengths(self, n: int) -> tuple[int, int]:
        """How many of the first shingles may meet a set of fewer members, and how many one of as many or more."""
        return n - math.ceil(self.t * n) + 1, n - math.ceil(self.both * n) + 1

    def prefix(self, made: np.ndarray) -> np.ndarray:
        if not len(made):
            return made
        known = np.zeros(len(made), np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, made), len(self.common) - 1)
            known = np.where(self.common[at] == made, self.counts[at], 0)
        return made[np.lexsort((made, known))[:self.lengths(len(made))[0]]]


def order_of(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, sample: int = SAMPLE, most: int = MOST) -> Order:
    """The order that at most ``sample`` texts (by hash) give; the ``most`` most frequent shingles of them count as common."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle).view(np.int64))], names=["shingle"])

    texts = hashed_share(docs, docs.count(), sample, "doc_id", "text").select("text")
    top = texts.mapInArrow(run, "shingle long").groupBy("shingle").count().where(f"count >= {LEAST}").orderBy(F.desc("count"), "shingle").limit(most).toPandas()
    return Order(top["shingle"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64), similarity)


def _shape(made: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(made.tobytes(), SEED)


def marked(docs: DataFrame, shingle: int, print_of: Callable[[list[int]], int]) -> DataFrame:
    """(doc_id, content, shape, print, bands) of every row: hashes of its text and of its shingle set, its fingerprint (a signed long) and the set's band keys."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, prints, keys = [], [], []
            for t in batch.column(1):
                every = shingle_hashes(t.as_py(), shingle)
                prints.append(print_of(every))
                made = _different(every)
                shapes.append(_shape(made))
                keys.append(bands(made).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(shapes, np.uint64).view(np.int64)),
                                              pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "content", "shape", "print", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("content"))
    return settled(rows.mapInArrow(run, "doc_id long, content long, shape long, print long, bands array<long>"))


def first_rows(rows: DataFrame) -> DataFrame:
    """(shape, first) of every shape: the row with the smallest doc_id (rows without one last), then content."""
    return rows.groupBy("shape").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "print")).alias("first"))


def same_row(docs: DataFrame, rows: DataFrame) -> Column:
    return docs["doc_id"].cast("long").eqNullSafe(rows["at_doc"]) & (F.xxhash64(docs["text"]) == rows["at_content"])


def _sets(docs: DataFrame, firsts: DataFrame, shingle: int) -> DataFrame:
    """(shape, made) of every shape in firsts (settled): its shingle set."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t.as_py(), shingle) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_shape(m) for m in made], np.uint64).view(np.int64)),
                                              pa.array([m.view(np.int64) for m in made], pa.list_(pa.int64()))], names=["shape", "made"])

    at = firsts.select(F.col("first.doc_id").alias("at_doc"), F.col("first.content").alias("at_content"))
    held = docs.join(at, same_row(docs, at), "left_semi").select("text").mapInArrow(run, "shape long, made array<long>")
    return few_tasks(settled(held.dropDuplicates(["shape"])), firsts.count(), SETS_A_TASK)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, apart) of the pairs whose shingle sets have at least that Jaccard similarity; apart is one less it."""
    one, two = sets.toDF("a", "of_a"), sets.toDF("b", "of_b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    n, m = F.size("of_a"), F.size("of_b")
    return settled_few(pairs.join(one, "a").join(two, "b").where(F.least(n, m) / F.greatest(n, m) >= similarity)
                   .withColumn("alike", common / (n + m - common)).where(F.col("alike") >= similarity).select("a", "b", (1 - F.col("alike")).alias("apart")))


def _groups(edges: DataFrame) -> DataFrame:
    """(shape, center, off) of every shape in verified edges (hub, shape, apart): the hub of most shapes among its own and itself, and the distance to it."""
    own = edges.select(F.col("a").alias("shape"), F.col("a").alias("center"), F.lit(0.0).alias("off")).distinct()
    near = edges.select(F.col("b").alias("shape"), F.col("a").alias("center"), F.col("apart").alias("off"))
    size = edges.groupBy(F.col("a").alias("center")).agg(F.count(F.lit(1)).alias("size"))
    best = own.unionByName(near).join(size, "center").groupBy("shape").agg(F.max(F.struct("size", "center", "off")).alias("best"))
    return best.select("shape", "best.center", "best.off")


def _bitmap(made: np.ndarray) -> list[int]:
    """WORDS longs: every shingle sets one bit."""
    out = np.zeros(WORDS * 64, np.uint8)
    out[made % np.uint64(WORDS * 64)] = 1
    return np.packbits(out).view(np.int64).tolist()


def _early_keys(sets: DataFrame, order: Order) -> DataFrame:
    """(shape, n, at, key, early, bits) of every set: its first shingles in the order; early ones may meet a larger set."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SETS_AT_ONCE):
                rows, bits = [], []
                part = batch.slice(first, SETS_AT_ONCE)
                for shape, held in zip(part.column(0).to_pylist(), part.column(1)):
                    made = held.values.to_numpy().view(np.uint64)
                    n = len(made)
                    keys = order.prefix(made).view(np.int64)
                    early = order.lengths(n)[1]
                    rows.append((np.full(len(keys), shape), np.full(len(keys), n, np.int32), np.arange(len(keys), dtype=np.int32), keys, np.arange(len(keys)) < early))
                    bits += [_bitmap(made)] * len(keys)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in zip(*rows)), pa.array(bits, pa.list_(pa.int64()))],
                                                 names=["shape", "n", "at", "key", "early", "bits"])

    return sets.mapInArrow(run, "shape long, n int, at int, key long, early boolean, bits array<long>")


def _bits_lacking(a: str, b: str) -> Column:
    """How many bits of the bitmap in columns a0, a1, ... those of b lack: shingles that the other set can't hold."""
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}{i}")))) for i in range(WORDS)), F.lit(0))


def _rare_parts(sets: DataFrame, grouped: DataFrame, order: Order) -> DataFrame:
    """The first shingles of sets, with class, center and off, whose keys bring different classes together; grouped is (shape, class, center, off)."""
    parts = _early_keys(sets, order).join(grouped, "shape")
    mixed = parts.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("early").alias("some")).where("low <> high AND some").select("key")
    bits = [F.get("bits", F.lit(i)).alias(f"bits{i}") for i in range(WORDS)]
    return settled_few(parts.join(mixed, "key").select("key", "shape", "n", "at", "early", "class", "center", "off", *bits))


def _rare_centers(parts: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) of centers of different classes under which a rare shingle brings texts together whose sizes and bitmaps allow the similarity.

    Under a key the texts of a center are one row: what every pair of two rows' texts would fail is left out, no similar pair is missed. The largest
    class of a key is not paired with itself.
    """
    per = parts.groupBy("key", "class", "center").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("at")).alias("rest"), F.max("early").alias("early"),
        *[F.bit_and(f"bits{i}").alias(f"all{i}") for i in range(WORDS)], *[F.bit_or(f"bits{i}").alias(f"any{i}") for i in range(WORDS)])
    main = per.groupBy("key", "class").count().groupBy("key").agg(F.max(F.struct("count", "class"))["class"].alias("main"))
    per = per.join(main, "key")
    x, y = (per.select("key", *[F.col(c).alias(f"{side}_{c}") for c in per.columns if c != "key"]) for side in "xy")
    least = F.lit(t / (1 + t)) * (F.col("x_lo") + F.col("y_lo")) - 1e-9  # shingles in common
    alike = (F.col("x_hi") >= F.lit(t - 1e-9) * F.col("y_lo")) & (F.col("y_hi") >= F.lit(t - 1e-9) * F.col("x_lo"))
    # the smaller set must hold the key early, and what follows the key must be enough to reach the similarity
    level = (F.col("x_lo") == F.col("y_hi")) & (F.col("y_lo") == F.col("x_hi"))
    smaller = F.when(F.col("x_hi") < F.col("y_lo"), F.col("x_early")).when(F.col("y_hi") < F.col("x_lo"), F.col("y_early")).when(
        level, F.col("x_early") & F.col("y_early")).otherwise(F.col("x_early") | F.col("y_early"))
    reach = F.least("x_rest", "y_rest") >= least
    common = F.least(F.col("x_hi") - _bits_lacking("x_all", "y_any"), F.col("y_hi") - _bits_lacking("y_all", "x_any")) >= least
    apart = (F.col("x_class") != F.col("y_class")) & ((F.col("y_class") == F.col("y_main")) | (F.col("x_center") < F.col("y_center")))
    return x.where("x_class <> x_main").join(y, "key").where(apart & alike & smaller & reach & common).select(
        F.least("x_center", "y_center").alias("a"), F.greatest("x_center", "y_center").alias("b")).distinct()


def _rare_links(parts: DataFrame, sets: DataFrame, t: float, similarity: float) -> DataFrame:
    """Similar pairs (a, b, apart) that connect all classes which a similar pair of texts under a rare shingle connects.

    Two centers that are similar connect their classes. Else a similar pair x, y under centers a, b has off(x) + off(y) + 1 - similarity >= apart(a, b).
    """
    seen = _verified(_rare_centers(parts, t), sets, 0.0)
    found = seen.where(F.col("apart") <= F.lit(1 - similarity))
    members = settled_few(parts.select("shape", "n", "center", "off", *[f"bits{i}" for i in range(WORDS)]).dropDuplicates(["shape"]))
    wide = members.groupBy("center").agg(F.max("off").alias("wide")).where("wide > 0")
    left = (seen.where(F.col("apart") > F.lit(1 - similarity)).withColumn("gap", F.col("apart") - F.lit(1 - similarity + 1e-9))
            .join(wide.toDF("a", "wide_a"), "a", "left").join(wide.toDF("b", "wide_b"), "b", "left")
            .select("a", "b", "gap", F.coalesce("wide_a", F.lit(0.0)).alias("wide_a"), F.coalesce("wide_b", F.lit(0.0)).alias("wide_b")).where("wide_a + wide_b >= gap"))
    x, y = (members.select(*[F.col(c).alias(f"{side}_{c}") for c in members.columns]) for side in "xy")
    n, m = F.col("x_n"), F.col("y_n")
    common = F.least(n - _bits_lacking("x_bits", "y_bits"), m - _bits_lacking("y_bits", "x_bits")) >= F.lit(t / (1 + t)) * (n + m) - 1e-9
    alike = F.least(n, m) >= F.lit(t - 1e-9) * F.greatest(n, m)
    pairs = (left.join(x, F.col("a") == F.col("x_center")).where("x_off + wide_b >= gap")
             .join(y, F.col("b") == F.col("y_center")).where(alike & common & (F.col("x_off") + F.col("y_off") >= F.col("gap")))
             .select(F.least("x_shape", "y_shape").alias("a"), F.greatest("x_shape", "y_shape").alias("b")).distinct())
    return found.unionByName(_verified(pairs, sets, similarity))


def near_components(docs: DataFrame, rows: DataFrame, firsts: DataFrame, shingle: int, similarity: float, near: DataFrame) -> DataFrame:
    """(node, component) of every shape that has a near copy; rows is ``marked``, firsts its ``first_rows``, near pairs (a, b) of shapes to check first.

    Those pairs are the ball's; a text that the check or the ball leaves apart may still be linked through the bands.
    """
    near = settled_few(near)
    parts = rows.select("shape", F.explode("bands").alias("key"))
    shared = parts.groupBy("key").agg(F.min("shape").alias("low"), F.max("shape").alias("high")).where("low <> high").select("key")
    members = settled_few(parts.join(shared, "key").distinct())
    # the text that copies were made from shares its buckets with all of them, a copy only those that its edits left alone
    degree = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key").groupBy("shape").agg(F.sum("size").alias("degree"))
    hubs = members.join(degree, "shape").groupBy("key").agg(F.max(F.struct("degree", "shape"))["shape"].alias("hub"))
    wanted = members.select("shape").union(near.select("a")).union(near.select("b")).distinct()
    sets = _sets(docs, settled_few(firsts.join(wanted, "shape", "left_semi")), shingle)
    inside = _verified(near, sets, similarity)
    stars = settled_few(members.join(hubs, "key").where("hub <> shape").select(F.col("hub").alias("a"), F.col("shape").alias("b")).distinct()
                    .join(inside.select("a", "b").union(inside.select("b", "a")), ["a", "b"], "left_anti"))
    edges = settled_few(inside.unionByName(_verified(stars, sets, similarity)))
    found = components(edges)
    placed = members.join(found, members["shape"] == found["node"], "left").select("key", "shape", F.coalesce("component", "shape").alias("class"))
    mixed = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    classes = settled_few(placed.join(mixed, "key", "left_semi").select("shape", "class").distinct())
    if classes.isEmpty():
        return found
    order = order_of(docs, shingle, similarity)
    grouped = classes.join(_groups(edges), "shape", "left").select("shape", "class", F.coalesce("center", "shape").alias("center"), F.coalesce("off", F.lit(0.0)).alias("off"))
    parts = _rare_parts(sets.join(classes.select("shape"), "shape", "left_semi"), grouped, order)
    return components(edges.unionByName(_rare_links(parts, sets, float(order.t), similarity)))
