"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Point, low and high end of the score interval; all 0 for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    none = n == 0
    return (F.when(none, 0.0).otherwise(p), F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + half)))


def nearest_rank(rank: Column, n: Column, fraction: float) -> Column:
    """Whether the row of 1-based rank is the nearest-rank percentile of n sorted values."""
    return rank == F.least(n - 1, F.floor(n * F.lit(fraction))) + 1


SEVERITY = ("ok", "insufficient_data", "warn", "crit")


def worst(*status: str) -> Column:
    order = [F.array_position(F.array(*map(F.lit, SEVERITY)), F.col(s)) for s in status]
    return F.element_at(F.array(*map(F.lit, SEVERITY)), F.greatest(*order).cast("int"))
