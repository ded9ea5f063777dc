"""Pairing of optical and radar scenes by date.

Optical scenes in order of date each take the radar scene nearest in days that
no other has taken; ties go to the one given first. That order is state: scenes
are streamed in order, each with the few radar scenes of its window, and the
state holds only the radar scenes taken within the last days. Scenes whose
dates are further apart than the window never compete, so every run of dates
without such a gap is streamed by itself: runs are spread over tasks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

DAYS = 3


def _date(c: str = "acquisition_date") -> Column:
    return F.to_date(F.left(F.col(c), F.lit(10)))


def pairs(optical: DataFrame, radar: DataFrame, days: int = DAYS, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, optical_scene_id, sar_scene_id, delta_days`` of scenes with ``scene_id, acquisition_date, input_ord``."""
    columns = [*by, "scene_id", "acquisition_date", "input_ord"]
    scenes = optical.select(*columns, F.lit(True).alias("is_optical")).unionByName(radar.select(*columns, F.lit(False).alias("is_optical"))).withColumn("day", _date())
    in_time = W.partitionBy(*by).orderBy("day")
    gap = F.datediff("day", F.lag("day").over(in_time)) > days
    runs = scenes.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("run", F.sum("gap").over(in_time.rangeBetween(W.unboundedPreceding, W.currentRow)))
    key = [*by, "run"]
    left = runs.where("is_optical").select(*key, F.col("scene_id").alias("o_id"), F.col("acquisition_date").alias("o_date"), F.col("input_ord").alias("o_ord"), "day")
    # each optical scene meets the radar scenes of the days in its window by key
    left = left.withColumn("near", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))))
    right = runs.where("NOT is_optical").select(*key, F.col("scene_id").alias("s_id"), F.col("input_ord").alias("s_ord"), F.col("day").alias("near"))
    met = left.join(right, [*key, "near"]).withColumn("delta", F.abs(F.datediff("near", "day")))
    asked = met.groupBy(*key, "o_date", "o_ord", "o_id", F.col("day").alias("o_day")).agg(F.array_sort(F.collect_list(F.struct("delta", "s_ord", "s_id"))).alias("choices"))
    kinds = [optical.schema[c].dataType for c in by]
    schema = T.StructType([*[T.StructField(c, k) for c, k in zip(by, kinds, strict=True)], T.StructField("optical_scene_id", T.StringType()), T.StructField("sar_scene_id", T.StringType()), T.StructField("delta_days", T.IntegerType())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, used = None, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = tuple(r[c] for c in key)
                if own != run:
                    run, used = own, {}
                used = {s: until for s, until in used.items() if until >= r["o_day"]}
                free = next((c for c in r["choices"] if c["s_id"] not in used), None)
                if free:
                    # a scene taken now can be asked for by scenes up to twice the window later
                    used[free["s_id"]] = r["o_day"] + dt.timedelta(2 * days)
                    out.append({**{c: r[c] for c in by}, "optical_scene_id": r["o_id"], "sar_scene_id": free["s_id"], "delta_days": free["delta"]})
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(schema))

    ordered = asked.repartition(*key).sortWithinPartitions(*key, "o_date", "o_ord", "o_id")
    return ordered.mapInArrow(take, schema)


def observations(optical: DataFrame, radar: DataFrame, days: int = DAYS) -> DataFrame:
    """Every scene in one observation: paired, optical only or radar only, in this order of ``ord``."""
    matched = pairs(optical, radar, days)
    left = optical.join(matched, optical["scene_id"] == matched["optical_scene_id"], "left")
    paired = F.col("sar_scene_id").isNotNull()
    first = left.select(
        F.concat_ws("__", optical["scene_id"], F.coalesce("sar_scene_id", F.lit("optical_only"))).alias("observation_id"),
        "acquisition_date",
        optical["scene_id"].alias("optical_scene_id"),
        "sar_scene_id",
        "crs",
        "resolution_m",
        F.when(paired, "optical_sar").otherwise("optical_only").alias("pairing"),
        "delta_days",
        F.struct(F.lit(0).alias("part"), F.col("acquisition_date").alias("date"), F.col("input_ord").alias("ord")).alias("ord"),
    )
    alone = radar.join(matched.select(F.col("sar_scene_id").alias("scene_id")), "scene_id", "left_anti").select(
        F.concat_ws("__", "scene_id", F.lit("sar_only")).alias("observation_id"),
        "acquisition_date",
        F.lit(None).cast("string").alias("optical_scene_id"),
        F.col("scene_id").alias("sar_scene_id"),
        "crs",
        "resolution_m",
        F.lit("sar_only").alias("pairing"),
        F.lit(None).cast("int").alias("delta_days"),
        F.struct(F.lit(1).alias("part"), F.lit("").alias("date"), F.col("input_ord").alias("ord")).alias("ord"),
    )
    return first.unionByName(alone)


def matched_pixels(observed: DataFrame, optical_pixels: DataFrame, radar_pixels: DataFrame, optical_bands: list[str], radar_bands: list[str]) -> DataFrame:
    """Pixels of observations on the grid of their optical scene, or of their radar scene if that is all they have.

    Radar pixels are looked up at the nearest place of the optical grid, so
    radar scenes of any shape fit.
    """
    size = lambda p, prefix: p.groupBy("scene_id").agg((F.max("row") + 1).alias(f"{prefix}_h"), (F.max("col") + 1).alias(f"{prefix}_w")).withColumnRenamed("scene_id", f"{prefix}_scene")
    radar = radar_pixels.select(F.col("scene_id").alias("sar_scene_id"), F.col("row").alias("s_row"), F.col("col").alias("s_col"), *radar_bands)
    o, s = size(optical_pixels, "o"), size(radar_pixels, "s")
    seen = observed.where("optical_scene_id IS NOT NULL").join(optical_pixels, F.col("optical_scene_id") == F.col("scene_id"))
    seen = seen.join(o, F.col("optical_scene_id") == F.col("o_scene")).join(s, F.col("sar_scene_id") == F.col("s_scene"), "left")
    place = lambda i, n, m: F.least(F.floor(F.col(i) * (F.lit(1.0) / (F.col(m).cast("double") / F.col(n).cast("double")))).cast("int"), F.col(n) - 1)
    seen = seen.withColumn("s_row", place("row", "s_h", "o_h")).withColumn("s_col", place("col", "s_w", "o_w"))
    key = ["observation_id", "acquisition_date", "row", "col"]
    both = seen.join(radar, ["sar_scene_id", "s_row", "s_col"], "left").select(*key, *optical_bands, *radar_bands)
    alone = observed.where("optical_scene_id IS NULL").join(radar, "sar_scene_id").withColumnRenamed("s_row", "row").withColumnRenamed("s_col", "col")
    return both.unionByName(alone.select(*key, *[F.lit(None).cast("double").alias(b) for b in optical_bands], *radar_bands))
