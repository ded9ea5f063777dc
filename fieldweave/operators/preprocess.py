"""Calibration, cloud masks and speckle filtering of scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ProcessingError
from ..functions import clip, decibels, greater, scale
from .grid import mean_filter, nearest_resample

REFLECTANCE = 0.0001
CLOUD = 0.4


def require_modality(scenes: DataFrame, modality: str) -> DataFrame:
    """``scenes``; reading one of another modality fails the query."""
    wrong = F.raise_error(F.concat(F.lit(f"a scene of modality {modality} is needed, not "), F.coalesce("modality", F.lit("null")))).cast("boolean")
    return scenes.where(F.when(F.col("modality") == modality, F.lit(True)).otherwise(wrong))


def cloud_reference(bands: Sequence[str]) -> str:
    """The band that tells clouds: blue, under either name, else the first."""
    if not bands:
        raise ProcessingError("a scene without bands has no cloud mask")
    return next((b for b in ("blue", "B02") if b in bands), bands[0])


def optical(pixels: DataFrame, bands: Sequence[str], *, by: Sequence[str] = ("scene_id",), shape: tuple[int, int] | None = None, factor: float = REFLECTANCE, threshold: float = CLOUD) -> DataFrame:
    """Reflectance between 0 and 1, and ``cloud``, on the target grid if one is given."""
    out = pixels.withColumns({b: clip(scale(F.col(b), factor), 0.0, 1.0) for b in bands})
    out = out.withColumn("cloud", greater(F.col(cloud_reference(bands)), threshold))
    return nearest_resample(out, by, *shape) if shape else out


def sar(pixels: DataFrame, bands: Sequence[str], *, by: Sequence[str] = ("scene_id",), shape: tuple[int, int] | None = None, calibration: float = 1.0, terrain: float = 1.0) -> DataFrame:
    """Backscatter in decibels, averaged over 3 by 3 pixels, on the target grid if one is given."""
    out = pixels.withColumns({b: decibels(scale(F.col(b), calibration)) for b in bands})
    out = mean_filter(out, by, bands).withColumns({b: scale(F.col(f"{b}_mean"), terrain) for b in bands}).drop(*[f"{b}_mean" for b in bands])
    return nearest_resample(out, by, *shape) if shape else out


def cloud_fraction(pixels: DataFrame, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    return pixels.groupBy(*by).agg(F.avg(F.col("cloud").cast("int")).alias("cloud_fraction"))
