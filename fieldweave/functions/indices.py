"""Vegetation, water, texture and radar features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arithmetic import EPSILON, as_double, clip, normalized_difference, safe_ratio


def _positive_guard(d: Column) -> Column:
    """Denominators near 0 count as positive, whatever their sign."""
    return F.when(F.abs(d) < EPSILON, F.lit(EPSILON)).otherwise(d)


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    nir, red, blue = as_double(nir), as_double(red), as_double(blue)
    return F.lit(2.5) * (nir - red) / _positive_guard(nir + F.lit(6.0) * red - F.lit(7.5) * blue + F.lit(1.0))


def savi(nir: Column, red: Column) -> Column:
    nir, red = as_double(nir), as_double(red)
    return F.lit(1.5) * (nir - red) / _positive_guard(nir + red + F.lit(0.5))


def gci(nir: Column, green: Column) -> Column:
    """The plain ratio, without subtracting 1."""
    return safe_ratio(nir, green)


def entropy(nir: Column) -> Column:
    p = clip(nir, 0.0, 1.0)
    return -p * F.ln(F.greatest(p, F.lit(EPSILON)))


def homogeneity(contrast: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + contrast)
