"""Helpers the operators of this subpackage share."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from takt.session import cut_lineage

BLANKS = b" \t\n\r\x0b\x0c"
ROWS_A_TASK = 50_000  # narrow rows that one task reads, if there are more tasks than cores


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: ``bytes.split`` splits at exactly these six characters."""
    return (text or "").encode().split()


def n_words(text: str | Column) -> Column:
    """Number of words of a text column, 0 for NULL, without Python."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def settled(df: DataFrame) -> DataFrame:
    """Narrow rows that several jobs read: computed once, kept in the shared checkpoint folder."""
    return cut_lineage(df)


def few_tasks(df: DataFrame, rows: int, at_once: int = ROWS_A_TASK) -> DataFrame:
    """df of at most ``rows`` rows in no more tasks than one for ``at_once`` of them, or one a core where that is more.

    A stage costs files and a log entry a task, so steps on few rows are not dealt to as many tasks as the session shuffles to.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / at_once)))


def settled_few(df: DataFrame) -> DataFrame:
    """``settled``, read in ``few_tasks``."""
    kept = settled(df)
    return few_tasks(kept, few_tasks(kept, 0).count())


def written(df: DataFrame, folder: str) -> DataFrame:
    """df as Parquet in folder, read back."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dropped(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate rows that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hashed_share(df: DataFrame, n: int, rows: int, *columns: str) -> DataFrame:
    """About ``rows`` of the n rows in df, by a hash of columns: what a fit on a bounded sample looks at."""
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < min(1 << 30, -(-rows * (1 << 30) // max(n, 1))))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def add_columns(df: DataFrame, column: str, make: Callable[[], Callable], fields: str) -> DataFrame:
    """Append what a Python function derives from each whole value of one column, Arrow batch by batch.

    ``make()`` runs once per task and returns the row function: value -> tuple in the order of ``fields``.
    All columns of df pass through unread.
    """
    added = _parse_datatype_string(fields)
    schema = StructType(df.schema.fields + added.fields)
    arrow = to_arrow_schema(added)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            got = [row(v.as_py()) for v in batch.column(column)]
            new = [pa.array([g[i] for g in got], type=f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *arrow.names])

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, keys: list[str], slice_col: str, order: list[str], size: Column | None = None,
             name: str = "position") -> DataFrame:
    """0-based running position per key (or the sum of ``size`` before the row) in the order (slice, order).

    A key is cut into slices that ascend with the order. Only slice totals, one row each after a map-side
    aggregate, are scanned per key; rows are sorted inside (key, slice), so a hot key is spread over many tasks.
    """
    step = size if size is not None else F.lit(1).cast("long")
    totals = df.groupBy(*keys, slice_col).agg(F.sum(step).alias("__total"))
    before = totals.select(*keys, slice_col, F.coalesce(F.sum("__total").over(
        Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__inside", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    same = [local[k].eqNullSafe(before[k]) for k in [*keys, slice_col]]
    out = local.join(before, same, "left")
    return out.select(*[local[c] for c in df.columns], (before["__before"] + local["__inside"]).cast("long").alias(name))
