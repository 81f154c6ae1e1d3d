"""Zipped run folders as a Spark data source: a split is one table's entry of one zip, read as a stream.

A bundle holds run folders (``run_x/units.csv``), or the tables of one run, named by the file. No task holds a whole zip or entry.
"""
from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from takt.contracts import TABLES
from takt.session import cut_lineage

ROWS_AT_ONCE = 20_000
WRITTEN = "run_id string, path string, records long"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _opened(path: str) -> zipfile.ZipFile:
    system, inner = _place(path)
    return zipfile.ZipFile(system.open_input_file(inner))


def bundle_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField("run_id", T.StringType()), *[f for f in TABLES[table].fields if f.name != "run_id"]])


class Entry(InputPartition):
    def __init__(self, path: str, entry: str):
        self.path, self.entry = path, entry


class RunBundles(DataSource):
    """Options: ``table`` (a name of the contract) and ``paths`` (a JSON list of zips)."""

    @classmethod
    def name(cls) -> str:
        return "run_bundles"

    def schema(self) -> T.StructType:
        return bundle_schema(self.options["table"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BundleReader(self.options["table"], json.loads(self.options["paths"]), schema)


class BundleReader(DataSourceReader):
    def __init__(self, table: str, paths: list[str], schema: T.StructType):
        self.table, self.paths, self.arrow = table, paths, to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        """One split an entry; only the zips' directories are read for it."""
        out = []
        for path in self.paths:
            with _opened(path) as z:
                found = [n for n in z.namelist() if os.path.basename(n) == f"{self.table}.csv"]
            if not found:
                raise ValueError(f"{path}: {self.table}.csv is missing")
            out += [Entry(path, n) for n in found]
        return out

    def read(self, partition: Entry) -> Iterator[pa.RecordBatch]:
        import pandas as pd
        folder = os.path.basename(os.path.dirname(partition.entry)) or os.path.splitext(os.path.basename(partition.path))[0]
        with _opened(partition.path) as z, z.open(partition.entry) as stream:
            for part in pd.read_csv(stream, dtype=str, chunksize=ROWS_AT_ONCE):
                columns = []
                for field in self.arrow:
                    c = part[field.name] if field.name in part else pd.Series([None] * len(part), dtype=object)
                    if field.name == "run_id" and "run_id" not in part:
                        c = pd.Series([folder] * len(part))
                    elif pa.types.is_boolean(field.type):
                        c = c.str.strip().str.lower().isin(["true", "1", "yes", "y"])
                    elif pa.types.is_integer(field.type) or pa.types.is_floating(field.type):
                        c = pd.to_numeric(c, errors="coerce")
                        c = c.where(c.notna(), None).astype("Int64") if pa.types.is_integer(field.type) else c
                    columns.append(pa.array(c, field.type, from_pandas=True))
                yield pa.RecordBatch.from_arrays(columns, schema=self.arrow)


def read_run_bundles(spark: SparkSession, glob: str, table: str) -> DataFrame:
    """One table out of all zips that match; a zip without it is an error. Bad numbers become NULL."""
    paths = [r["path"] for r in spark.read.format("binaryFile").load(glob).select("path").collect()]  # a listing: contents are not read
    if not paths:
        return spark.createDataFrame([], bundle_schema(table))
    spark.dataSource.register(RunBundles)
    return spark.read.format("run_bundles").option("table", table).option("paths", json.dumps(sorted(paths))).load()


def write_run_bundles(rows: DataFrame, folder: str, table: str, order: list[str]) -> DataFrame:
    """Every run's rows as ``<run_id>.zip`` below folder; returns (run_id, path, records). A run is streamed into its zip, in order, by one task."""
    names = [f.name for f in TABLES[table].fields if f.name != "run_id"]
    ready = rows.select("run_id", *names, *[c for c in order if c not in names]).repartition("run_id").sortWithinPartitions("run_id", *order).select("run_id", *names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in batches:
            pdf = b.to_pandas()
            for run_id, part in pdf.groupby("run_id", sort=False):
                if now is None or now.run_id != run_id:
                    if now:
                        done.append(now.close())
                    now = _Bundle(folder, run_id, table)
                now.add(part.drop(columns="run_id"))
        if now:
            done.append(now.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("run_id", "path", "records"), d)) for d in done], schema=pa.schema(
            [("run_id", pa.string()), ("path", pa.string()), ("records", pa.int64())]))

    return cut_lineage(ready.mapInArrow(run, WRITTEN))


class _Bundle:
    """One zip in the writing; it gets its name when whole."""

    def __init__(self, folder: str, run_id: str, table: str):
        self.run_id, self.records = run_id, 0
        self.system, self.path = _place(f"{folder}/{run_id}.zip")
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.trial = f"{self.path}.{os.urandom(8).hex()}.part"
        self.sink = self.system.open_output_stream(self.trial, compression=None)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_DEFLATED)
        self.entry = self.zip.open(f"{run_id}/{table}.csv", "w", force_zip64=True)

    def add(self, part) -> None:
        text = io.StringIO()
        part.to_csv(text, index=False, header=self.records == 0)
        self.entry.write(text.getvalue().encode())
        self.records += len(part)

    def close(self) -> tuple[str, str, int]:
        self.entry.close()
        self.zip.close()
        self.sink.close()
        self.system.move(self.trial, self.path)
        return self.run_id, self.path, self.records
