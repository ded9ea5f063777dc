"""Normalisation of rasters by statistics of their own.

Statistics are aggregates, combined before the shuffle, one row per raster;
they come back by a join, so that no task holds a raster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import as_double, minmax, standardize


def _with(pixels: DataFrame, by: Sequence[str], statistics: dict[str, Column], value, name: str) -> DataFrame:
    """``pixels`` and ``value`` of the statistics of its group; nulls are a group of their own."""
    found = pixels.groupBy(*by).agg(*[c.alias(f"_{k}") for k, c in statistics.items()])
    found = found.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[f"_{k}" for k in statistics])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] or [F.lit(True)]
    joined = pixels.join(found if by else F.broadcast(found), same)
    return joined.select(*pixels.columns, value(*[F.col(f"_{k}") for k in statistics]).alias(name))


def minmax_normalize(pixels: DataFrame, column: str, by: Sequence[str] = (), name: str = "normalized") -> DataFrame:
    """Adds ``name``: within each group 0 for the least value, 1 for the greatest; all 0 if they are equal."""
    x = as_double(column)
    return _with(pixels, by, {"low": F.min(x), "high": F.max(x)}, lambda low, high: minmax(x, low, high), name)


def zscore_normalize(pixels: DataFrame, column: str, by: Sequence[str] = (), name: str = "normalized") -> DataFrame:
    """Adds ``name``: distance from the group's mean in population deviations; a deviation near 0 counts as 1."""
    x = as_double(column)
    return _with(pixels, by, {"mean": F.avg(x), "std": F.stddev_pop(x)}, lambda mean, std: standardize(x, mean, std), name)
