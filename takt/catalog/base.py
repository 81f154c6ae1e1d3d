"""Registration helpers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry():
    """(queries, oracle, decorator) of one catalog module."""
    queries, oracle = {}, {}

    def query(name: str, sql: str | None = None):
        def put(fn):
            queries[name] = fn
            if sql:
                oracle[name] = sql
            return fn
        return put
    return queries, oracle, query


def rounded(df: DataFrame, digits: dict | None = None, default: int = 5) -> DataFrame:
    """Round doubles before engines are compared."""
    digits = digits or {}
    return df.select(*[F.round(F.col(c), digits.get(c, default)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def rounded_sql(columns, doubles, digits: dict | None = None, default: int = 5) -> str:
    digits = digits or {}
    return ", ".join(f"round({c}, {digits.get(c, default)}) AS {c}" if c in doubles else c for c in columns)
