"""Feature cubes: spectral, texture and radar features of observations, a row per pixel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FeatureError
from ..functions import entropy, evi, gci, homogeneity, ndvi, ndwi, safe_ratio, savi
from ..schemas import ALIASES
from .grid import mean_filter

OPTICAL = ("ndvi", "evi", "ndwi", "savi", "gci", "texture_contrast", "texture_entropy", "texture_homogeneity")
RADAR = ("vv", "vh", "vh_vv_ratio")


def band(columns: Sequence[str], name: str) -> str | None:
    return next((a for a in ALIASES[name] if a in columns), None)


def features(pixels: DataFrame, by: Sequence[str] = ("observation_id",), *, keep: Sequence[str] = ()) -> DataFrame:
    """``by, row, col, keep`` and all features that the bands allow; red stands in for missing blue and green."""
    columns = pixels.columns
    found = {name: band(columns, name) for name in ALIASES}
    optical = any(found[n] for n in ("red", "nir", "blue", "green"))
    if optical and not (found["red"] and found["nir"]):
        raise FeatureError("optical features need the bands red and nir")
    out: dict[str, Column] = {}
    if optical:
        red, nir = F.col(found["red"]), F.col(found["nir"])
        green, blue = (F.col(found[n]) if found[n] else red for n in ("green", "blue"))
        pixels = mean_filter(pixels, by, [found["nir"]])
        contrast = F.abs(nir.cast("double") - F.col(f"{found['nir']}_mean"))
        values = (ndvi(nir, red), evi(nir, red, blue), ndwi(green, nir), savi(nir, red), gci(nir, green), contrast, entropy(nir), homogeneity(contrast))
        out.update(zip(OPTICAL, values, strict=True))
    if found["vv"]:
        out["vv"] = F.col(found["vv"]).cast("double")
    if found["vh"]:
        out["vh"] = F.col(found["vh"]).cast("double")
    if found["vv"] and found["vh"]:
        out["vh_vv_ratio"] = safe_ratio(F.col(found["vh"]), F.col(found["vv"]))
    if not out:
        raise FeatureError("no feature can be made from these bands")
    return pixels.select(*by, "row", "col", *keep, *[c.alias(name) for name, c in out.items()])


def means(cube: DataFrame, names: Sequence[str], by: Sequence[str] = ("observation_id", "acquisition_date")) -> DataFrame:
    """One vector per observation: the mean of each feature, NaN if any pixel is."""
    return cube.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])
