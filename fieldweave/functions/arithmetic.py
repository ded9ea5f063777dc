"""Raster arithmetic as column expressions, in doubles.

Spark and SQL order NaN above all numbers; rasters do not, so comparisons and
bounds here leave NaN alone: NaN is never greater, and a clipped NaN is NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6
#: Least linear backscatter; -60 dB.
FLOOR = 1e-6


def as_double(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def greater(x: Column, bound: float | Column) -> Column:
    """``x > bound``, false for NaN."""
    return ~F.isnan(x) & (x > bound)


def scale(x: Column, factor: float, offset: float = 0.0) -> Column:
    return as_double(x) * float(factor) + float(offset)


def clip(x: Column, low: float, high: float) -> Column:
    x = as_double(x)
    return F.when(F.isnan(x) | x.isNull(), x).otherwise(F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def guarded(x: Column, epsilon: float = EPSILON) -> Column:
    """``x``, moved away from 0 to ``epsilon`` with its sign; 0 counts as positive."""
    x = as_double(x)
    small = F.abs(x) < epsilon
    return F.when(small & (x >= 0), F.lit(epsilon)).when(small, F.lit(-epsilon)).otherwise(x)


def safe_ratio(n: Column, d: Column, epsilon: float = EPSILON) -> Column:
    return as_double(n) / guarded(d, epsilon)


def normalized_difference(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    a, b = as_double(a), as_double(b)
    return safe_ratio(a - b, a + b, epsilon)


def decibels(x: Column) -> Column:
    x = as_double(x)
    return F.lit(10.0) * F.log10(F.when(F.isnan(x) | x.isNull(), x).otherwise(F.greatest(x, F.lit(FLOOR))))


def minmax(x: Column, low: Column, high: Column) -> Column:
    """0 for the least value, 1 for the greatest; all 0 if they are equal."""
    return F.when(high == low, F.lit(0.0)).otherwise((as_double(x) - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low))


def _spread(deviation: Column) -> Column:
    return F.when(deviation < 1e-8, F.lit(1.0)).otherwise(deviation)


def standardize(x: Column, mean: Column | float, deviation: Column | float) -> Column:
    """With given statistics; a deviation near 0 counts as 1."""
    column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return (as_double(x) - column(mean)) / _spread(column(deviation))


def as_float(x: Column | str) -> Column:
    """Single precision, as arrays for machine learning have it."""
    return (F.col(x) if isinstance(x, str) else x).cast("float")


def zeros_like(_: Column | str) -> Column:
    """0 in single precision for every row."""
    return F.lit(0.0).cast("float")


def ones_like(_: Column | str) -> Column:
    """1 in single precision for every row."""
    return F.lit(1.0).cast("float")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if the product of the lengths is near 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths < 1e-8, F.lit(0.0)).otherwise(dot(a, b) / F.when(lengths < 1e-8, F.lit(1.0)).otherwise(lengths))
