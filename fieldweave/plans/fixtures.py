"""Scenes, pixels and nodes projected from generic tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPTICAL = ["red", "nir", "green", "blue", "swir"]
RADAR = ["vv", "vh"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of 20 by 20 pixels from ``events``, all bands as raw numbers."""
    return load(spark, sf_dir, "events").selectExpr(
        "event_id div 400 AS scene",
        "CAST((event_id % 400) div 20 AS INT) AS row",
        "CAST(event_id % 20 AS INT) AS col",
        "value * 20D AS red",
        "CAST((event_id * 37 + user_id * 11) % 10001 AS DOUBLE) AS nir",
        "CAST((event_id * 53 + 7) % 10001 AS DOUBLE) AS green",
        "CAST((event_id * 71 + user_id) % 10001 AS DOUBLE) AS blue",
        "CAST((event_id * 17 + 3) % 10001 AS DOUBLE) AS swir",
        "value / 245D AS vv",
        "CAST((event_id * 29) % 1000 AS DOUBLE) / 500D AS vh",
    )


def scenes(spark: SparkSession, sf_dir: str, days: int = 2) -> DataFrame:
    """One header per scene: even ones optical, odd ones radar."""
    ids = load(spark, sf_dir, "events").selectExpr("event_id div 400 AS scene").distinct()
    return ids.select(
        F.col("scene").cast("string").alias("scene_id"),
        F.when(F.col("scene") % 2 == 0, "optical").otherwise("sar").alias("modality"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("scene") * days).cast("int")).cast("string").alias("acquisition_date"),
        F.when(F.col("scene") % 11 == 10, "").otherwise("EPSG:32643").alias("crs"),
        F.lit(10.0).alias("resolution_m"),
        F.col("scene").alias("input_ord"),
    )


def supplier_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nodes: features of four small whole numbers, some of length 0; one in seven has no soil."""
    return load(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS node_id",
        "s_acctbal AS x",
        "CAST(s_suppkey AS DOUBLE) AS y",
        "CASE WHEN s_suppkey % 9 = 0 THEN array(0D, 0D, 0D, 0D) ELSE array(CAST(s_suppkey * 7 % 13 - 6 AS DOUBLE), CAST(s_suppkey * 5 % 11 - 5 AS DOUBLE), CAST(s_suppkey * 3 % 17 - 8 AS DOUBLE), CAST(s_suppkey % 19 - 9 AS DOUBLE)) END AS features",
        "CAST(s_nationkey AS string) AS irrigation_id",
        "CASE WHEN s_suppkey % 7 > 0 THEN concat('soil', s_suppkey % 23) END AS soil_type",
        "abs(s_acctbal) AS rainfall_mm",
    )


def embedding_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").selectExpr("vec_id AS node_id", "CAST(vec_id * 100000 AS DOUBLE) AS x", "0D AS y", "embedding AS features", "CAST(NULL AS string) AS irrigation_id", "concat('s', label) AS soil_type", "CAST(vec_id * 1000 AS DOUBLE) AS rainfall_mm")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog items as JSON text from ``pages``."""
    return load(spark, sf_dir, "pages").selectExpr(
        """to_json(named_struct('id', concat('p', page_id % 200), 'collection', element_at(array('sentinel-2-l2a', 'sentinel-1-grd', 'weather-daily', 'soil-map', 'landsat-l1c'), CAST(page_id % 5 AS INT) + 1),
        'properties', map('datetime', concat('2024-02-', lpad(CAST(page_id % 28 + 1 AS string), 2, '0'), 'T10:00:00Z'), 'gsd', CAST(page_id % 60 AS string), 'proj:epsg', CASE WHEN page_id % 3 = 0 THEN NULL ELSE CAST(32600 + page_id % 60 AS string) END, 'eo:cloud_cover', CAST(page_id % 101 AS string)),
        'assets', map('visual', named_struct('href', url), 'B04', named_struct('href', concat(url, '/b04'))))) AS item""",
        "page_id",
    )
