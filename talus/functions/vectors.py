"""Vector arithmetic on array columns, in double precision and within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def negative_inner_product(a: Column | str, b: Column | str) -> Column:
    """The order in which nearest comes first."""
    return -dot(a, b)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; null where a side is null or zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size)


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - cosine distance, clamped at 0; 0 where it is null or no number."""
    return F.greatest(F.nanvl(F.coalesce(1 - cosine_distance(a, b), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def is_unit(a: Column | str, tolerance: float = 1e-3, dim: int | None = None) -> Column:
    """False for a wrong norm, length or component that is no number."""
    col = F.col(a) if isinstance(a, str) else a
    ok = F.abs(norm(col) - 1) <= tolerance
    return ok if dim is None else ok & (F.size(col) == dim)


def rrf(rank: Column, k: int = 60) -> Column:
    """1 / (k + rank), 0 for a leg without the row."""
    return F.coalesce(F.lit(1.0) / (F.lit(float(k)) + rank), F.lit(0.0))


def rrf_with_default(rank: Column, k: int = 20, absent: int = 101) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + F.coalesce(rank, F.lit(absent)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def half_precision(column: str) -> Column:
    """Components rounded as 16-bit storage does: 11 bits of mantissa, ties to even, steps of 2^-24 near zero. Beyond 65504
    they are infinite."""

    def one(x: Column) -> Column:
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
        near = F.bround(x / step, 0) * step
        near = F.when(F.abs(near) > 65504, F.signum(x) * F.lit(float("inf"))).otherwise(near)
        return F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(near)

    return F.transform(F.col(column).cast("array<double>"), one)
