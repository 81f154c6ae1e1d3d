"""Token files: Arrow IPC files of equal-length sequences and masks as fixed-size lists, readable in place."""
from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takt.llm.tokens import encoder
from takt.sources.runs import shared_folder

VOCABULARY, END, LENGTH = "byte_bpe_50k.json", 2, 2048
ROWS_A_SHARD, SEQUENCES_A_BATCH = 8192, 64
SHARD = "shard int, path string, n_docs long, n_tokens long"


def width(size: int) -> pa.DataType:
    """The smallest unsigned type that holds all ids of a vocabulary."""
    return pa.uint16() if size <= 1 << 16 else pa.uint32()


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Writes one shard: ``ids`` (a row a sequence: ids and mask) and ``docs`` (doc_id, start in the shard, n_tokens).

    Sequences are the shard's ids one after another, cut every ``length``; the last is filled up with 0 under a
    mask of false. Files get their names when whole, so a lost or repeated task leaves a whole file or none.
    """

    def __init__(self, path: str, kind: pa.DataType, length: int, batch: int):
        self.system, self.path = place(path)
        self.length, self.batch = length, batch
        self.kind = kind
        self.schema = pa.schema([pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.try_name = uuid.uuid4().hex
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.sinks = [self.system.open_output_stream(f"{self.path}.{n}.{self.try_name}") for n in ("ids", "docs")]
        self.files = [pa.ipc.new_file(s, c) for s, c in zip(self.sinks, (self.schema, self.index))]
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0

    def add(self, docs: list[int | None], texts_ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in texts_ids], np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.files[1].write_batch(pa.record_batch([pa.array(docs, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.index))
        self.n_tokens += int(sizes.sum())
        self.n_docs += len(docs)
        self.held += texts_ids
        self.n_held += int(sizes.sum())
        if self.n_held >= self.length * self.batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        step = self.length * self.batch  # all batches but the last have as many sequences
        whole = len(ids) if last else len(ids) // step * step
        self.held, self.n_held = [ids[whole:]], len(ids) - whole
        for at in range(0, whole, step):
            part = ids[at:min(at + step, whole)]
            rows = -(-len(part) // self.length)
            mask = np.arange(rows * self.length) < len(part)
            part = np.pad(part, (0, rows * self.length - len(part))).astype(self.kind.to_pandas_dtype())
            self.files[0].write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(part), self.length),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> tuple[int, int]:
        self._flush(True)
        for file, sink, name in zip(self.files, self.sinks, ("ids", "docs")):
            file.close()
            sink.close()
            self.system.move(f"{self.path}.{name}.{self.try_name}", f"{self.path}.{name}.arrow")
        return self.n_docs, self.n_tokens


class Shard:
    """One shard opened for reading; local files are mapped, not copied."""

    def __init__(self, path: str):
        system, path = place(path)
        self.sources = [pa.memory_map(f"{path}.{n}.arrow") if isinstance(system, fs.LocalFileSystem)
                        else system.open_input_file(f"{path}.{n}.arrow") for n in ("ids", "docs")]
        self.ids, self.docs = (pa.ipc.open_file(s) for s in self.sources)
        self.length = self.ids.schema.field("ids").type.list_size
        first = self.ids.get_batch(0).num_rows if self.ids.num_record_batches else 1
        self.rows_a_batch = max(1, first)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence i."""
        batch, row = self.ids.get_batch(i // self.rows_a_batch), i % self.rows_a_batch
        ids, mask = (batch.column(c).values.slice((batch.column(c).offset + row) * self.length, self.length) for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of all documents in order, one batch of sequences after another."""
        number, at, held = 0, 0, np.zeros(0, self.ids.schema.field("ids").type.value_type.to_pandas_dtype())
        for b in range(self.docs.num_record_batches):
            for doc, start, n in zip(*(c.to_pylist() for c in self.docs.get_batch(b).columns)):
                need = start + n - at
                if need > len(held):
                    more = [held]
                    have = len(held)
                    while have < need:
                        column = self.ids.get_batch(number).column(0)
                        more.append(column.values.to_numpy())
                        have, number = have + len(more[-1]), number + 1
                    held = np.concatenate(more)
                yield doc, start, held[start - at:start - at + n]
                held, at = held[start + n - at:], start + n


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH,
                 rows_a_shard: int = ROWS_A_SHARD, batch: int = SEQUENCES_A_BATCH) -> list:
    """Write all documents below folder in ascending doc_id order; return (shard, path, n_docs, n_tokens) of each shard.

    Documents are dealt by ranges of doc_id, so shards follow each other; each is written batch by batch as it is
    read, by one task. The list has one short row a shard.
    """
    shards = max(1, -(-docs.count() // rows_a_shard))
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_last())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path, encode, writer = f"{folder}/shard-{shard:08d}", encoder(vocabulary), None
        for b in batches:
            ids, texts, step = b.column(0).to_pylist(), b.column(1), 2048
            for at in range(0, len(ids), step):
                writer = writer or ShardWriter(path, width(encode.size), length, batch)
                made = [np.append(x, np.uint32(end)).astype("<u4") for x in encode.encode(texts.slice(at, step).to_pylist())]
                writer.add(ids[at:at + step], made)
        if writer:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": n_docs, "n_tokens": n_tokens}],
                                             schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return sorted(rows.mapInArrow(run, SHARD).collect(), key=lambda r: r["shard"])


def read_tokens(spark, shards: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, start counted over all shards."""
    before, listed = 0, []
    for r in shards:
        listed.append((r["path"], before))
        before += r["n_tokens"]
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long"
    table = spark.createDataFrame(listed, "path string, before long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for path, base in zip(*(c.to_pylist() for c in b.columns)):
                rows = [(doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in Shard(path).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return table.repartition(max(1, len(listed))).mapInArrow(run, fields)


def written_tokens(docs: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Write docs as token files in folder (a new one in the shared folder by default) and report what they hold.

    Per row: doc_id, start (ids of all documents before it), n_tokens (end id included), ids_crc32. NULL and
    empty texts hold the end id alone. Repeated doc_ids lie next to each other by text; rows without a doc_id come
    last. An empty table writes no shard and gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, folder or shared_folder(spark), **settings))
