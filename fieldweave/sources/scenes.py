"""Scenes from memory, Parquet and GeoTIFF files, and their summary."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ProcessingError
from ..schemas import SCENES


def ensure_same_shape(*arrays: np.ndarray) -> tuple[int, int]:
    if not arrays or any(a.shape != arrays[0].shape for a in arrays):
        raise ProcessingError("bands of one shape are needed")
    return arrays[0].shape


def from_arrays(spark: SparkSession, scene_id: str, modality: str, date: str, bands: Mapping[str, np.ndarray], *, crs: str = "", resolution_m: float = 0.0, input_ord: int = 0, metadata: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The header and the pixels of a scene given as arrays; empty without bands."""
    height, width = ensure_same_shape(*bands.values()) if bands else (0, 0)
    header = spark.createDataFrame([(scene_id, modality, date, crs, float(resolution_m), height, width, input_ord, dict(metadata or {}))], SCENES)
    rows, cols = np.indices((height, width))
    table = pd.DataFrame({"scene_id": scene_id, "row": rows.ravel().astype("int32"), "col": cols.ravel().astype("int32")} | {n: np.asarray(b, "float64").ravel() for n, b in bands.items()})
    schema = "scene_id string, row int, col int" + "".join(f", `{n}` double" for n in bands)
    return header, spark.createDataFrame(table, schema)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``scenes`` and ``pixels`` as written by :func:`write`."""
    return spark.read.parquet(f"{path}/scenes"), spark.read.parquet(f"{path}/pixels")


def write(scenes: DataFrame, pixels: DataFrame, path: str) -> None:
    """Pixels are kept by scene, so reading some scenes reads only their files."""
    scenes.write.mode("overwrite").parquet(f"{path}/scenes")
    pixels.repartition("scene_id").write.mode("overwrite").partitionBy("scene_id").parquet(f"{path}/pixels")


def load_geotiff(spark: SparkSession, path: str, modality: str = "optical", scene_id: str | None = None, date: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """All bands of a file, named B01, B02, ... by position. Needs the optional package rasterio."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    try:
        import rasterio
    except ImportError as error:
        raise ProcessingError("reading GeoTIFF files needs the package rasterio") from error
    with rasterio.open(path) as file:
        bands = {f"B{i:02d}": file.read(i) for i in range(1, file.count + 1)}
        return from_arrays(spark, scene_id or Path(path).stem, modality, date, bands, crs=str(file.crs), resolution_m=float(file.res[0]))


def describe(scenes: DataFrame, pixels: DataFrame) -> DataFrame:
    """Per scene: header, number of pixels, and least, mean and greatest value of each band."""
    bands = [c for c, kind in pixels.dtypes if kind in ("double", "float") and c not in ("scene_id", "row", "col")]
    stats = [f(b).alias(f"{b}_{name}") for b in bands for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    return scenes.join(pixels.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_pixels"), *stats), "scene_id", "left")
