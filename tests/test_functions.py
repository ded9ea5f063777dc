import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave import functions as fn
from fieldweave.operators import normalize


def values(spark, column, rows, schema="a double, b double"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_scale_and_clip_keep_nan(spark):
    out = values(spark, fn.clip(fn.scale(F.col("a"), 0.0001), 0, 1), [(-5.0, 0.0), (5000.0, 0.0), (20000.0, 0.0), (math.nan, 0.0), (None, 0.0)])
    assert out[:3] == [0.0, 0.5, 1.0] and math.isnan(out[3]) and out[4] is None


def test_guards_keep_the_sign(spark):
    assert values(spark, fn.safe_ratio(F.col("a"), F.col("b")), [(1.0, -1e-9), (1.0, 1e-9), (1.0, 0.0), (1.0, 4.0)]) == pytest.approx([-1e6, 1e6, 1e6, 0.25])
    assert values(spark, fn.normalized_difference(F.col("a"), F.col("b")), [(3.0, 1.0)]) == [0.5]
    assert values(spark, fn.evi(F.col("a"), F.lit(0.0), F.col("b")), [(0.0, 2 / 15)])[0] == 0


def test_nan_is_never_greater(spark):
    assert values(spark, fn.greater(F.col("a"), 0.8), [(math.nan, 0.0), (0.9, 0.0), (0.8, 0.0)]) == [False, True, False]


def test_decibels(spark):
    assert values(spark, fn.decibels(F.col("a")), [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]) == pytest.approx([-60, 0, 3.0103], abs=1e-4)


def test_group_norms(spark):
    rows = [(1.0, 0.0), (3.0, 0.0), (5.0, 0.0), (7.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, g double")
    out = normalize.zscore_normalize(normalize.minmax_normalize(df, "a", ["g"], "m"), "a", ["g"], "z").orderBy("a").collect()
    assert [r["m"] for r in out] == [0, 0.5, 1, 0]
    x = np.array([1.0, 3, 5])
    assert [r["z"] for r in out] == pytest.approx([*((x - x.mean()) / x.std()), 0])
    whole = normalize.minmax_normalize(df.select("a").union(df.select("a")), "a").collect()
    assert sorted(r["normalized"] for r in whole) == pytest.approx([0, 0, 1 / 3, 1 / 3, 2 / 3, 2 / 3, 1, 1])


def test_single_precision(spark):
    df = spark.createDataFrame([(1 / 3, None)], "a double, b double").select(fn.as_float("a").alias("x"), fn.zeros_like("b").alias("z"), fn.ones_like("b").alias("o"))
    assert [t for _, t in df.dtypes] == ["float"] * 3 and tuple(df.first()) == (np.float32(1 / 3), 0, 1)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(fn.cosine_similarity(F.col("a"), F.col("b"))).collect()] == pytest.approx([2**-0.5, 0])
