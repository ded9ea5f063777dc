"""Scenes that arrive as files: read once each, deduplicated, appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCENES


def arriving(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Headers of scenes in JSON files as a stream, with the time of arrival."""
    return spark.readStream.schema(SCENES).option("maxFilesPerTrigger", files_at_once).json(folder).withColumn("arrived", F.current_timestamp())


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, delay: str = "1 day") -> int:
    """Append what has arrived since the last call to the table at ``table``, each scene once within ``delay``; batches done."""
    stream = arriving(spark, folder).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["scene_id"])
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])
