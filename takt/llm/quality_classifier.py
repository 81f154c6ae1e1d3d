"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, numpy descent."""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takt.llm.common import settled

BUCKETS, DIM, EPOCHS, RATE, BATCH, SEED = 1 << 15, 16, 6, 1.0, 32, 5
GAIN = 500.0
TRAIN_ROWS = 3_000
GRAMS = (3, 4)
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
CHUNK_CHARS = 500_000


@dataclass(frozen=True)
class Model:
    """A bucket's vector per row, and the softmax layer over two classes."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For each code point of the basic plane: 1 capital, 2 letter, 3 digit, else the point itself."""
    chars = map(chr, range(1 << 16))
    return np.array([1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else ord(c) for c in chars], np.uint64)


def bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * MIX
    return ((h ^ (h >> np.uint64(29))) * MIX >> np.uint64(33)) % np.uint64(BUCKETS)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words without white space: (word number, bucket) of all their n-grams, and a hash of each word.

    A word has a bucket of its own, one of its shape (runs of capitals, letters, digits), and one for each of
    its character n-grams, with marks at both ends. All words are hashed at once as one array of characters.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = np.frombuffer("\n".join([f"<{w}>" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    gap = c == 10
    word = np.cumsum(gap)
    start = np.concatenate(([0], np.flatnonzero(gap) + 1))
    power = np.cumprod(np.full(int(np.diff(np.append(start, len(c) + 1)).max()) + 1, STEP))
    inside = np.arange(len(c)) - start[word]
    value = np.where(gap, np.uint64(0), c * power[inside])
    whole = np.add.reduceat(value, start)
    kind = np.where(c < 1 << 16, kinds()[np.minimum(c, (1 << 16) - 1).astype(np.int64)], np.uint64(2))
    turn = np.concatenate(([True], kind[1:] != kind[:-1])) & ~gap
    rank = np.cumsum(turn)
    rank = rank - rank[start][word]
    shape = np.add.reduceat(np.where(turn, (kind + np.uint64(7)) * power[np.maximum(rank, 0)], np.uint64(0)), start)
    numbers = np.arange(len(words))
    owner, ids = [numbers, numbers], [bucket(whole, 1), bucket(shape, 2)]
    for n in GRAMS:
        m = len(c) - n + 1
        if m > 0:
            fits = np.flatnonzero((word[:m] == word[n - 1:]) & ~gap[:m])
            h = c[fits]
            for k in range(1, n):
                h = h * STEP + c[fits + k]
            owner.append(word[fits])
            ids.append(bucket(h, 10 + n))
    return np.concatenate(owner), np.concatenate(ids).astype(np.int64), whole


def pair_buckets(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Buckets of two-word n-grams of word hashes; a word said twice running has one of its own, whatever it is."""
    return np.where(first == second, 1, bucket(first * STEP + second * MIX, 3).astype(np.int64))


def chunks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    held, chars = [], 0
    for t in texts:
        held.append(t or "")
        chars += len(held[-1])
        if chars >= CHUNK_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words, the number of each text's each word among them, and where texts begin."""
    lists = [t.split() for t in map(str.encode, texts)]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    coded = pa.array([w for x in lists for w in x], pa.binary()).cast(pa.string()).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64), bounds


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of a text: half lies on words and their n-grams, half on word pairs, if any."""
    distinct, codes, _ = split([text or ""])
    owner, ids, whole = grams(distinct)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0)
    share = np.bincount(codes) / len(codes) / np.bincount(owner)
    weight = share[owner]
    if len(codes) > 1:
        pairs = pair_buckets(whole[codes[:-1]], whole[codes[1:]])
        ids, weight = np.concatenate([ids, pairs]), np.concatenate([weight / 2, np.full(len(pairs), 0.5 / len(pairs))])
    ids, place = np.unique(ids, return_inverse=True)
    return ids, np.bincount(place, weight)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = DIM, epochs: int = EPOCHS,
        rate: float = RATE, batch: int = BATCH, seed: int = SEED) -> Model:
    """Stochastic gradient descent over (buckets, shares, label); the rate falls to 0 in a straight line.

    Rows of the rarer label weigh more, so that both count alike in sum. With one label or no rows, the softmax
    layer learns that label alone, or nothing (score 1/2).
    """
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    labels = np.array([r[2] for r in rows], np.int64)
    share = np.bincount(labels, minlength=2) / max(len(rows), 1)
    scale = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0.0)
    steps, done = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for at in range(0, len(rows), batch):
            part = [rows[i] for i in order[at:at + batch]]
            y = labels[order[at:at + batch]]
            size = np.array([len(p[0]) for p in part])
            owner = np.repeat(np.arange(len(part)), size)
            ids, w = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part]).astype(np.float32)
            hidden = np.zeros((len(part), dim), np.float32)
            full = np.flatnonzero(size)
            if len(full):
                hidden[full] = np.add.reduceat(vectors[ids] * w[:, None], (np.cumsum(size) - size)[full])
            gap = softmax(hidden @ weights + bias)
            gap[np.arange(len(part)), y] -= 1
            gap *= (scale[y] / len(part))[:, None]
            step = rate * (1 - done / steps)
            back = gap @ weights.T
            weights -= step * hidden.T @ gap
            bias -= step * gap.sum(axis=0)
            # a document's average moves by its own gradient; buckets get their share of it, enlarged to offset averaging
            order_ids = np.argsort(ids, kind="stable")
            sorted_ids = ids[order_ids]
            heads = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
            moved = np.add.reduceat((back[owner] * w[:, None])[order_ids], heads) if len(heads) else np.zeros((0, dim))
            vectors[sorted_ids[heads]] -= (step * GAIN * moved).astype(np.float32)
            done += 1
    return Model(vectors, weights, bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return (e / e.sum(axis=1, keepdims=True)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **settings) -> Model:
    """Fit on ``rows`` labelled documents at most (a documented bound), the first by a hash of their doc_id.

    The features of the sample, at most one number a bucket and row, come to the driver, no text does.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null")
    sample = settled(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for b in batches:
            made = [(i.astype("<i4").tobytes(), s.astype("<f4").tobytes()) for i, s in map(features, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), *(pa.array([m[k] for m in made], kinds[2 + k]) for k in (0, 1))],
                names=["doc_id", "quality", "ids", "shares"])

    got = texts.mapInArrow(run, "doc_id long, quality int, ids binary, shares binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["ids"]), bytes(r["shares"])))
    return fit([(np.frombuffer(r["ids"], "<i4").astype(np.int64), np.frombuffer(r["shares"], "<f4"), r["quality"]) for r in got], **settings)


def held_out(doc_id: str) -> Column:
    """crc32 of doc_id as text, modulo 3, is 1: such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """Chance of label 1 of each text. Words' averages are added up by word, pairs by bucket."""
    out = []
    flat = model.vectors.astype(float) @ model.weights  # averaging and the linear layer commute: two numbers a bucket
    for part in chunks(texts):
        distinct, codes, bounds = split(part)
        owner, ids, whole = grams(distinct)
        z = np.zeros((len(part), 2))
        n = np.diff(bounds)
        some, many = n > 0, n > 1
        for k in range(2 if len(codes) else 0):
            per_word = np.bincount(owner, flat[ids, k]) / np.bincount(owner)
            sums = np.concatenate(([0.0], np.cumsum(per_word[codes])))
            runs = np.concatenate(([0.0], np.cumsum(flat[pair_buckets(whole[codes[:-1]], whole[codes[1:]]), k])))
            a, b = bounds[:-1], bounds[1:]
            z[some, k] = (sums[b[some]] - sums[a[some]]) / n[some]
            z[many, k] = z[many, k] / 2 + (runs[b[many] - 1] - runs[a[many]]) / (2 * (n[many] - 1))
        out.append(softmax(z + model.bias)[:, 1].astype(float))
    return np.concatenate(out) if out else np.zeros(0)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    score is the chance that quality is 1, from the whole text alone; predicted is 1 from 0.5 on. NULL and empty
    texts, and texts of white space, get the score of the softmax layer's bias. Equal texts have equal scores,
    repeated rows are repeated, a NULL doc_id is not held out; an empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out("doc_id"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(model, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

