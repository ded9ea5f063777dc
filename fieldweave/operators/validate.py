"""Rules on scenes, cubes, sequences and graphs; each gives rows ``severity, rule, subject, message``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import DatasetError

CLOUDS = 0.4
#: Fixed texts of the messages; what follows or stands for %s is the subject.
DUPLICATE, NO_CRS, NO_BANDS = "Duplicate scene: ", "Missing CRS for ", "Missing bands for "
CLOUDY, NO_MODALITY, NO_FEATURES = "High cloud cover for ", "Missing modality: ", "Feature cube has no features: "
NOT_IN_ORDER, REPEATED_TIMES = "Sequence %s timestamps are not chronological", "Sequence %s contains duplicate timestamps"
NO_NODE, NO_GRAPH = "Graph edge references invalid node index: ", "Vision-only pipeline: graph validation skipped."


def _issue(rows: DataFrame, severity: str, rule: str, subject: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), message.alias("message"))


def duplicates(scenes: DataFrame) -> DataFrame:
    """One error for each repetition of an id."""
    again = scenes.withColumn("n", F.row_number().over(W.partitionBy("scene_id").orderBy("input_ord"))).where("n > 1")
    return _issue(again, "error", "duplicate_scene", F.col("scene_id"), F.concat(F.lit(DUPLICATE), "scene_id"))


def missing_crs(scenes: DataFrame) -> DataFrame:
    return _issue(scenes.where(F.coalesce("crs", F.lit("")) == ""), "error", "missing_crs", F.col("scene_id"), F.concat(F.lit(NO_CRS), "scene_id"))


def missing_bands(scenes: DataFrame) -> DataFrame:
    """For scenes with a column ``n_bands``."""
    return _issue(scenes.where(F.coalesce("n_bands", F.lit(0)) == 0), "error", "missing_bands", F.col("scene_id"), F.concat(F.lit(NO_BANDS), "scene_id"))


def _two_places(share: str) -> Column:
    """A share between 0 and 1 with two places, rounded by its exact binary value, ties to even."""
    unit = 1 << 60  # shares from 2^-7 on are whole multiples of its inverse
    doubled = f"(CAST(CAST({share} * {unit}D AS BIGINT) AS DECIMAL(38, 0)) * 200 + {unit})"
    up = f"({doubled} div {2 * unit})"
    return F.expr(f"format_string('%.2f', ({up} - CASE WHEN {doubled} % {2 * unit} = 0 AND {up} % 2 = 1 THEN 1 ELSE 0 END) / 100D)")


def clouds(fractions: DataFrame, most: float = CLOUDS) -> DataFrame:
    high = fractions.where(F.col("cloud_fraction") > most)
    return _issue(high, "warning", "high_cloud", F.col("scene_id"), F.concat(F.lit(CLOUDY), F.col("scene_id").cast("string"), F.lit(": "), _two_places("cloud_fraction")))


def missing_modalities(scenes: DataFrame, wanted: tuple[str, ...] = ("optical", "sar")) -> DataFrame:
    asked = scenes.sparkSession.createDataFrame([(m,) for m in wanted], "modality string")
    absent = asked.join(scenes.select("modality").distinct(), "modality", "left_anti")
    return _issue(absent, "warning", "missing_modality", F.col("modality"), F.concat(F.lit(NO_MODALITY), "modality"))


def empty_cubes(cubes: DataFrame) -> DataFrame:
    """For ``observation_id, n_features``."""
    return _issue(cubes.where("n_features = 0"), "error", "empty_cube", F.col("observation_id"), F.concat(F.lit(NO_FEATURES), "observation_id"))


def sequences(steps: DataFrame) -> DataFrame:
    """For ``sequence_id, step, ts``: order by time and repeated times."""
    late = steps.withColumn("before", F.lag("ts").over(W.partitionBy("sequence_id").orderBy("step"))).where("ts < before").select("sequence_id").distinct()
    twice = steps.groupBy("sequence_id").agg((F.count("ts") > F.count_distinct("ts")).alias("twice")).where("twice")
    order = _issue(late, "error", "not_chronological", F.col("sequence_id"), F.format_string(NOT_IN_ORDER, "sequence_id"))
    return order.unionByName(_issue(twice, "warning", "duplicate_timestamps", F.col("sequence_id"), F.format_string(REPEATED_TIMES, "sequence_id")))


def edge_integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One error for each node that edges name and that is none."""
    named = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    unknown = named.join(nodes.select("node_id"), "node_id", "left_anti")
    return _issue(unknown, "error", "invalid_node", F.col("node_id"), F.concat(F.lit(NO_NODE), F.col("node_id").cast("string")))


def empty_graph(nodes: DataFrame) -> DataFrame:
    """A warning if there are no nodes; such a graph is valid."""
    n = nodes.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return _issue(n, "warning", "empty_graph", F.lit("graph"), F.lit(NO_GRAPH))


def unlike_features(cubes: DataFrame, order: str = "input_ord") -> DataFrame:
    """For ``observation_id, features`` (names): errors for cubes whose features are not those of the first one."""
    first = cubes.agg(F.min_by(F.array_sort("features"), order).alias("wanted"))
    unlike = cubes.join(F.broadcast(first), F.array_sort("features") != F.col("wanted"))  # one row
    lacking = F.concat_ws(", ", F.array_except("wanted", "features"))
    more = F.concat_ws(", ", F.array_except("features", "wanted"))
    return _issue(unlike, "error", "unlike_features", F.col("observation_id"), F.format_string("Feature cube %s lacks [%s] and adds [%s]", "observation_id", lacking, more))


def counts(**tables: DataFrame) -> DataFrame:
    """``what, n``: the number of rows of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, t in tables.items()])


def report(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def check(issues: DataFrame, path: str | None = None, named: int = 100) -> DataFrame:
    """Write the report, if a path is given, and only then fail on errors; the first ``named`` messages and the number of all are in the error."""
    if path:
        issues.write.mode("overwrite").json(path)
    wrong = issues.where("severity = 'error'")
    errors = wrong.orderBy("rule", "subject").limit(named + 1).collect()
    if errors:
        more = f"; {wrong.count() - named} more errors are in the report" if len(errors) > named else ""
        raise DatasetError("; ".join(r["message"] for r in errors[:named]) + more)
    return issues
