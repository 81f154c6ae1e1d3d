"""Best-fit packing by sums of squares: documents as token pieces into as few sequences of fixed length as can be."""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takt.llm.common import settled
from takt.llm.tokens import encoder

VOCABULARY, END, LENGTH = "word_bpe_49k.json", 0, 2048
GROUP_PIECES = 50_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long"

CHARS_AT_ONCE = 1_000_000


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts: ids, then the end id, cut every ``length`` ids; NULL is an empty text."""
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows = []
            texts = (t.as_py() for t in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts, CHARS_AT_ONCE)):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), length)):
                    part = ids[at:at + length]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            columns = list(zip(*rows)) if rows else [[]] * (6 if with_ids else 5)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, taken in the given order.

    N(g) counts open sequences with g ids left. A piece goes where the sum of N(g) squared becomes smallest:
    into an open sequence (N(g) falls, N(g - size) rises) or, when none has room, a new one. Of equal choices
    the smallest gap that has room wins.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[size:]) + size
        if len(gaps):
            # half the change of the sum, less one; a filled sequence counts no more
            change = np.where(gaps == size, -0.5, count[gaps - size]) - count[gaps]
            gap = int(gaps[np.argmin(change)])
            at = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, at, made = capacity, made, made + 1
        number[i], offset[i] = at, capacity - gap
        if gap > size:
            open_at[gap - size].append(at)
            count[gap - size] += 1
    return number, offset


def packed(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with the sequence they lie in and their place there.

    Pieces are dealt by a hash of themselves and their number into groups of about ``group_pieces``, far more than a sequence
    holds, so groups lose next to nothing and no task grows with the data, whatever documents are like. In a
    group the largest pieces come first; full ones fill their sequence alone. Sequence numbers are unique over
    all groups; offsets of a sequence are gapless from 0. No pieces give no rows.
    """
    held = settled(pieces)
    groups = max(1, -(-held.count() // group_pieces))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        number, offset = place(part["length"].to_numpy(), length)
        part["sequence_id"] = part["group_"].to_numpy() * (1 << 40) + number
        part["offset"] = offset
        return part.drop(columns="group_")

    # the number of a row in what was written makes copies differ; it is read back the same by any task that runs again
    dealt = held.withColumn("group_", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("group_").applyInPandas(run, PLACED)


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH) -> DataFrame:
    """One row a piece of every row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of over ``length`` ids (end id included) are cut. NULL and empty texts are one piece, the
    end id. Repeated rows are packed as often as they occur; doc_id may be NULL. Other columns are not read.
    """
    return packed(pieces(docs, vocabulary, end, length), length)
