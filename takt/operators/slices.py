"""Ordered scans that never put a whole key into one task.

A key (a station, a unit, a run) may hold a large part of all rows, so a plain
``Window.partitionBy(key)`` would sort it in one task. Here each key is cut into *slices* along
its order column. Rows are scanned inside (key, slice), every slice is reduced to one summary row
by a map-side aggregate, and only the summaries are scanned per key. The two results are merged:

    running value at a row = value over earlier slices  (+)  value inside this slice

Sums, maxima, minima and "latest value" are all mergeable this way, so results are exact whatever
the slice width; the width only sets how much one task holds.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takt.functions.scalar import col

UNBOUNDED = Window.unboundedPreceding
ROWS_A_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks to deal that many rows to: as many as the session shuffles to, more if one would hold over ROWS_A_TASK.

    Adaptive execution merges small shuffle partitions by their compressed bytes. Rows of a line log shrink so much
    that a merged task may hold gigabytes of them; a repartition to a number of tasks stays as it is.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_A_TASK))


def slice_number(ts, width) -> Column:
    """Floor division of an integer clock, exact for negative values as well."""
    t = col(ts).cast("long")
    return ((t - F.pmod(t, F.lit(int(width)).cast("long"))) / F.lit(int(width))).cast("long")


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """The columns of a one-row table beside every row of df: a scalar subquery, run once, instead of a join."""
    if not one.columns:
        return df
    held = df.withColumn("__one", one.select(F.struct(*one.columns)).scalar())
    return held.select(*df.columns, *[F.col("__one")[c].alias(c) for c in one.columns])


@dataclass(frozen=True)
class Running:
    """One running aggregate: kind is 'sum', 'max', 'min', 'latest' or 'first'."""

    kind: str
    value: Column


def total(value) -> Running:
    return Running("sum", col(value))


def peak(value) -> Running:
    return Running("max", col(value))


def lowest(value) -> Running:
    return Running("min", col(value))


def latest(value) -> Running:
    """Last non-NULL value so far, in the scan order."""
    return Running("latest", col(value))


def _fold(kind: str, c: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min,
            "latest": lambda x: F.last(x, ignorenulls=True)}[kind](c)


def _merge(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    if kind == "max":
        return F.greatest(before, here)
    if kind == "min":
        return F.least(before, here)
    return F.coalesce(here, before)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Running],
            width: int | None = None, slice_col: Column | None = None, strict: bool = False,
            slice_keys: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """Add running aggregates per key in the given order.

    The first order column decides the slice (``width``), unless ``slice_col`` gives any other
    expression that never decreases along the order. ``strict`` leaves the row itself out. With
    ``tasks`` slices are dealt to so many tasks, and sorted before the values are made.
    """
    keys, order = list(keys), list(order)
    names = list(columns)
    base = df.withColumn("__s", slice_col if slice_col is not None else slice_number(order[0], width))
    if tasks:
        base = base.repartition(tasks, *keys, "__s").sortWithinPartitions(*keys, "__s", *order)
    for n in names:
        base = base.withColumn(f"__v_{n}", columns[n].value)
    inside = (Window.partitionBy(*keys, "__s").orderBy(*order)
              .rowsBetween(UNBOUNDED, -1 if strict else 0))
    local = base.select("*", *[_fold(columns[n].kind, F.col(f"__v_{n}")).over(inside).alias(f"__l_{n}")
                               for n in names]).drop(*[f"__v_{n}" for n in names])

    def summary(n: str) -> Column:
        v, kind = F.col(f"__v_{n}"), columns[n].kind
        if kind == "latest":
            return F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))
        return _fold(kind, v)

    per_slice = base.groupBy(*keys, "__s").agg(*[summary(n).alias(f"__p_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("__s").rowsBetween(UNBOUNDED, -1)
    carried = per_slice.select(*keys, "__s", *[
        _fold(columns[n].kind, F.col(f"__p_{n}")).over(earlier).alias(f"__c_{n}") for n in names])
    return (local.join(carried, [*keys, "__s"], "left")
            .select(*df.columns, *[_merge(columns[n].kind, F.col(f"__c_{n}"), F.col(f"__l_{n}")).alias(n)
                                   for n in names if n not in df.columns]))


def previous(df: DataFrame, keys, order, values: dict[str, str], width: int | None = None,
             slice_col: Column | None = None) -> DataFrame:
    """Lag over sliced keys: for each output name the previous row's value of a column."""
    held = F.struct(*[F.col(src).alias(f"f{i}") for i, src in enumerate(values.values())])
    out = running(df, keys, order, {"__prev": latest(held)}, width, slice_col, strict=True)
    return out.select(*df.columns, *[F.col("__prev")[f"f{i}"].alias(n) for i, n in enumerate(values)])


def numbered(df: DataFrame, keys, order, width: int | None = None, slice_col: Column | None = None,
             name: str = "rn") -> DataFrame:
    """Exact 1-based row number per key, computed slice-wise."""
    return running(df, keys, order, {name: total(F.lit(1).cast("long"))}, width, slice_col)


def last_rows(df: DataFrame, keys, rn: str, columns: dict[str, Column], back: int,
              block: int = 65_536) -> DataFrame:
    """Window aggregates over the last ``back`` + 1 rows of a numbered key.

    ``columns`` maps names to aggregates (not yet windowed). Rows are dealt into blocks of equal
    size and the last ``back`` rows of a block are copied to the next one, so a block is the
    largest unit of work even when one key holds most rows.
    """
    blocked = df.withColumn("__b", slice_number(F.col(rn) - 1, block))
    halo = F.when((F.col("__b") + 1) * block - F.col(rn) < back,
                  F.array(F.struct(F.col("__b").alias("b"), F.lit(True).alias("own")),
                          F.struct((F.col("__b") + 1).alias("b"), F.lit(False).alias("own")))
                  ).otherwise(F.array(F.struct(F.col("__b").alias("b"), F.lit(True).alias("own"))))
    copies = blocked.withColumn("__h", F.explode(halo))
    w = Window.partitionBy(*keys, F.col("__h.b")).orderBy(rn).rowsBetween(-back, 0)
    return (copies.select("*", *[c.over(w).alias(n) for n, c in columns.items()])
            .filter(F.col("__h.own")).drop("__b", "__h"))


def as_of(left: DataFrame, right: DataFrame, keys, left_ts: str, right_ts: str, take: Sequence[str],
          right_tie: Sequence[str] = (), width: int = 600_000, strict: bool = False, tasks: int | None = None) -> DataFrame:
    """For each left row the latest right row at or before it (before it, when ``strict``).

    Both sides go through one sorted scan per (key, slice); no product of rows is formed. Ties on
    the right clock are settled by ``right_tie``, largest wins. Unmatched rows get NULLs.
    """
    keys = list(keys)
    # at equal clocks the right side comes first, or last when strict
    right_rank, left_rank = (1, 0) if strict else (0, 1)
    tie = F.struct(*[F.col(c) for c in right_tie]) if right_tie else F.struct(F.lit(0).alias("t0"))
    carried = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(take)])
    r = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(right_rank).alias("__k"),
                     tie.alias("__tie"), carried.alias("__r"),
                     F.lit(False).alias("__is_left"))
    l_all = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(left_rank).alias("__k"),
                    l_all.alias("__row"), F.lit(True).alias("__is_left"))
    both = l.unionByName(r, allowMissingColumns=True)
    out = running(both, keys, ["__t", "__k", "__tie"], {"__m": latest(F.col("__r"))}, width, tasks=tasks)
    return (out.filter("__is_left")
            .select("__row.*", *[F.col("__m")[f"c{i}"].alias(c) for i, c in enumerate(take)]))


def exact_quantiles(df: DataFrame, keys, value, outputs: dict[str, float],
                    slice_col: Column | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per key.

    Equal values are merged before any shuffle; the ranks come from a sliced scan over distinct
    values, so neither a large group nor a wide value range is held in one task.
    """
    keys = list(keys)
    v = df.select(*keys, col(value).cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    return hist_quantiles(v.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n")), keys, outputs, slice_col)


def hist_quantiles(hist: DataFrame, keys, outputs: dict[str, float], slice_col: Column | None = None) -> DataFrame:
    """The same from merged value counts (keys, __x, __n)."""
    x = F.col("__x")
    bucket = slice_col if slice_col is not None else (
        F.signum(x) * F.floor(F.log2(1 + F.abs(x)) * 32)).cast("long")
    # only the slices that hold an asked rank are sorted
    sliced = hist.withColumn("__s", bucket)
    along = Window.partitionBy(*keys).orderBy("__s").rowsBetween(UNBOUNDED, -1)
    slices = sliced.groupBy(*keys, "__s").agg(F.sum("__n").alias("__in")).select(
        *keys, "__s", "__in", F.coalesce(F.sum("__in").over(along), F.lit(0)).alias("__before"), F.sum("__in").over(Window.partitionBy(*keys)).alias("__size"))
    ranks = [end(F.lit(q) * (F.col("__size") - 1)) for q in outputs.values() for end in (F.floor, F.ceil)]
    asked = slices.filter(reduce(or_, [(F.col("__before") <= r) & (r < F.col("__before") + F.col("__in")) for r in ranks])).drop("__in")
    inside = Window.partitionBy(*keys, "__s").orderBy("__x").rowsBetween(UNBOUNDED, 0)
    joined = sliced.join(asked, [*keys, "__s"]).withColumn("__cum", F.col("__before") + F.sum("__n").over(inside))
    aggs = []
    for name, q in outputs.items():
        pos = F.lit(q) * (F.col("__size") - 1)
        aggs += [F.min(F.when(F.col("__cum") > F.floor(pos), x)).alias(f"__lo_{name}"),
                 F.min(F.when(F.col("__cum") > F.ceil(pos), x)).alias(f"__hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"__f_{name}")]
    got = joined.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[(F.col(f"__lo_{n}") + F.col(f"__f_{n}")
                                * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n) for n in outputs])
