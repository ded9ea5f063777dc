"""Sequences of fixed length with equal steps, gaps filled and marked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import SequenceError

STEP, LENGTH = 10, 8


def timeline(vectors: DataFrame, step: int = STEP, length: int = LENGTH, by: Sequence[str] = ()) -> DataFrame:
    """``by, step, day``: dates from the first on, ``step`` days apart; ``inside`` up to the last date."""
    if length <= 0 or step <= 0:
        raise SequenceError("length and step of a sequence are positive")
    bounds = vectors.groupBy(*by).agg(F.min("day").alias("first"), F.max("day").alias("last")).where("first IS NOT NULL")
    steps = bounds.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return steps.withColumn("day", F.date_add("first", F.col("step") * step)).select(*by, "step", "day", (F.col("day") <= F.col("last")).alias("inside"))


def sequence(means: DataFrame, names: Sequence[str], *, step: int = STEP, length: int = LENGTH, by: Sequence[str] = (), order: str = "input_ord") -> DataFrame:
    """``by, step, ts, mask, features``: observed values, or the midpoint of the neighbours in time, or zeros beyond the end.

    ``means``: ``acquisition_date``, the features and ``order``; of several on
    one date the last in that order counts. Neighbours are observations, on
    the timeline or not.
    """
    day = F.to_date(F.left("acquisition_date", F.lit(10)))
    vector = F.array(*[F.col(n).cast("double") for n in sorted(names)])
    seen = means.withColumn("day", day).groupBy(*by, "day").agg(F.max_by(vector, order).alias("v"))
    grid = timeline(seen, step, length, by)
    rows = grid.withColumn("v", F.lit(None).cast("array<double>")).unionByName(seen.withColumn("step", F.lit(None).cast("int")).withColumn("inside", F.lit(None).cast("boolean")))
    time = W.partitionBy(*by).orderBy("day")
    before = F.last("v", ignorenulls=True).over(time.rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.first("v", ignorenulls=True).over(time.rangeBetween(W.currentRow, W.unboundedFollowing))
    here = F.max("v").over(W.partitionBy(*by, "day"))
    filled = rows.withColumn("here", here).withColumn("b", F.coalesce(before, after)).withColumn("a", F.coalesce(after, before)).where("step IS NOT NULL")
    middle = F.zip_with("b", "a", lambda x, y: (x + y) / 2.0)
    zeros = F.array_repeat(F.lit(0.0), len(names))
    value = F.when(~F.col("inside"), zeros).when(F.col("here").isNotNull(), F.col("here")).otherwise(middle)
    mask = (F.col("inside") & F.col("here").isNotNull()).cast("long")
    return filled.select(*by, "step", F.col("day").alias("ts"), mask.alias("mask"), value.alias("features"))
