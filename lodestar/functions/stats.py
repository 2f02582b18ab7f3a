"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """A share whose empty base counts as one."""
    return numerator / F.greatest(denominator, F.lit(1))


def quantile(column: Column, q: float) -> Column:
    """Exact, linearly interpolated; 0 for no values."""
    return F.coalesce(F.percentile(column, F.lit(q)), F.lit(0.0))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share, within [0, 1]; (0, 0) without observations."""
    middle, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    clip = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)
    return clip(middle - spread), clip(middle + spread)


def mean_relative_accuracy(prediction: Column, target: Column) -> Column:
    """Share of the thresholds .50, .55 ... .95 that the relative error meets; 0 for no prediction or target 0."""
    error = F.abs(prediction - target) / F.abs(target)
    met = sum((F.when(error <= (50 - 5 * i) / 100, 1).otherwise(0) for i in range(10)), F.lit(0)) / 10.0
    return F.when(prediction.isNull() | (target == 0), F.lit(0.0)).otherwise(met)


def retry_delay(attempt: Column) -> Column:
    """Seconds before the next attempt: doubled each time, 30 at most."""
    return F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt - 1))


def retriable(error: Column, marks: list[str]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(F.lower(error), m)), F.lit(False))
