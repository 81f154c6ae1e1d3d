"""Gamma distribution fits as column expressions (no solver, no Python per row)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 6  # the asymptotic series is used from x + 6 on


def digamma(x: Column) -> Column:
    z = x + _SHIFT
    low = sum((1 / (x + j) for j in range(1, _SHIFT)), 1 / x)
    i2 = 1 / (z * z)
    return F.ln(z) - 1 / (2 * z) - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 / 240))) - low


def trigamma(x: Column) -> Column:
    z = x + _SHIFT
    low = sum((1 / ((x + j) * (x + j)) for j in range(1, _SHIFT)), 1 / (x * x))
    i, i2 = 1 / z, 1 / (z * z)
    return i + i2 / 2 + i * i2 * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 / 30))) + low


def gamma_shape(mean: Column, mean_log: Column, steps: int = 6) -> Column:
    """Maximum-likelihood shape at location 0 from E[x] and E[ln x]; NULL for (near) zero spread.

    Closed-form start, then Newton steps inside a fold so that the expression does not grow.
    """
    s = F.ln(mean) - mean_log
    start = (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)
    newton = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda k, _: F.greatest(
        F.lit(1e-6), k - (F.ln(k) - digamma(k) - s) / (1 / k - trigamma(k))))
    return F.when(s > 1e-9, newton)
