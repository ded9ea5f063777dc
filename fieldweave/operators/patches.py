"""Training patches: windows of feature cubes, numbered, split, standardised by the training part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import ModelInputError
from .grid import patch_pixels

SIZE = STRIDE = 256


def split_of(index: Column, n: Column) -> Column:
    """``train``, ``val`` or ``test`` by place: 70 and 85 hundredths in binary fractions, one for training at least."""
    train = F.greatest(F.lit(1), F.floor(n * F.lit(0.7)).cast("long"))
    val = F.greatest(train, F.floor(n * F.lit(0.85)).cast("long"))
    return F.when(index < train, "train").when(index < val, "val").otherwise("test")


def splits(patches: DataFrame, sequences: int = 0, nodes: int = 0) -> DataFrame:
    """The exported splits: indices up to the largest of the three datasets; they may differ from those of patches alone."""
    n = F.greatest(F.count(F.lit(1)), F.lit(sequences), F.lit(nodes))
    size = patches.agg(n.alias("n")).where("n > 0")
    return size.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(split_of(F.col("index"), F.col("n")).alias("split"), "index")


def long_patches(cube: DataFrame, names: Sequence[str], by: Sequence[str] = ("observation_id",), size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """``by, row0, col0, channel, row, col, raw``: a row per value of each full window, places within the window."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n).cast("double").alias("raw")) for n in sorted(names)])).alias("v")
    cut = patch_pixels(cube.select(*by, "row", "col", *names), by, size, stride)
    return cut.select(*by, "row0", "col0", (F.col("row") - F.col("row0")).alias("row"), (F.col("col") - F.col("col0")).alias("col"), values).select(*by, "row0", "col0", "row", "col", "v.channel", "v.raw")


def moments(values: DataFrame, by: Sequence[str] = ("observation_id",)) -> DataFrame:
    """``by, row0, col0, channel, n, mean, variance, low, high, broken``: one pass over the values for all that windows are judged by."""
    broken = F.coalesce(F.bool_or(F.isnan("raw") | F.col("raw").isNull()), F.lit(True))
    return values.groupBy(*by, "row0", "col0", "channel").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("mean"), F.var_pop("raw").alias("variance"), F.min("raw").alias("low"), F.max("raw").alias("high"), broken.alias("broken"))


def validity(measured: DataFrame, by: Sequence[str] = ("observation_id",)) -> DataFrame:
    """Per window of :func:`moments`: ``valid`` unless a value is NaN or missing, or all are equal over all channels."""
    return measured.groupBy(*by, "row0", "col0").agg((~F.bool_or("broken") & (F.max("high") > F.min("low"))).alias("valid"))


def numbered(windows: DataFrame, order: Sequence[str] = ("observation_id",)) -> DataFrame:
    """Valid windows with a dense ``patch_id`` by cube, row and column, and their split.

    One small row per patch; numbers come from counts per cube, so that no
    task orders more than a cube's patches.
    """
    valid = windows.where("valid").drop("valid")
    sizes = valid.groupBy(*order).agg(F.count(F.lit(1)).alias("in_cube"))
    offsets = sizes.withColumn("before", F.sum("in_cube").over(W.orderBy(*order)) - F.col("in_cube")).withColumn("n", F.sum("in_cube").over(W.partitionBy()))
    place = F.row_number().over(W.partitionBy(*order).orderBy("row0", "col0")) - 1
    out = valid.withColumn("place", place).join(offsets, list(order)).withColumn("patch_id", (F.col("before") + F.col("place")).cast("long"))
    return out.withColumn("split", split_of(F.col("patch_id"), F.col("n"))).select("patch_id", *order, "row0", "col0", "split")


def train_statistics(measured: DataFrame, patches: DataFrame, by: Sequence[str] = ("observation_id",)) -> DataFrame:
    """``channel, mean, std`` over the training patches, from the moments of each; a deviation near 0 counts as 1.

    The variance of all values is the mean of the windows' own ones and the
    variance of their means, each as often as a window has values.
    """
    own = measured.join(patches.where("split = 'train'").select(*by, "row0", "col0"), [*by, "row0", "col0"])
    n = F.col("n").cast("double")
    mean = F.sum(F.col("mean") * n) / F.sum(n)
    centre = own.groupBy("channel").agg(mean.alias("centre"))
    spread = own.join(F.broadcast(centre), "channel").groupBy("channel").agg(F.first("centre").alias("mean"), F.sqrt(F.sum(n * (F.col("variance") + F.pow(F.col("mean") - F.col("centre"), 2))) / F.sum(n)).alias("std"))
    return spread.withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def normalized(values: DataFrame, patches: DataFrame, statistics: DataFrame, by: Sequence[str] = ("observation_id",)) -> DataFrame:
    """All values of valid patches, standardised; the statistics are one row per channel."""
    own = values.join(patches, [*by, "row0", "col0"]).join(F.broadcast(statistics), "channel")
    return own.select("patch_id", "split", "channel", "row", "col", "raw", ((F.col("raw") - F.col("mean")) / F.col("std")).alias("normalized"))


def prepare(cube: DataFrame, names: Sequence[str], by: Sequence[str] = ("observation_id",), size: int = SIZE, stride: int = STRIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patches, training statistics and standardised values; an error if no window is valid.

    Pixels are gone through for the moments of windows and for the
    standardised values; all between needs a row per window and channel only.
    """
    values = long_patches(cube, names, by, size, stride)
    measured = moments(values, by).checkpoint() if _can_checkpoint(cube) else moments(values, by)
    patches = numbered(validity(measured, by), by)
    if not patches.limit(1).count():
        raise ModelInputError("no valid patch")
    statistics = train_statistics(measured, patches, by)
    return patches, statistics, normalized(values, patches, statistics, by)


def _can_checkpoint(df: DataFrame) -> bool:
    """Whether the session has a folder for checkpoints that executors share."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def tensors(values: DataFrame) -> DataFrame:
    """``patch_id, split, tensor``: one array per patch, by channel, row and column."""
    ordered = F.array_sort(F.collect_list(F.struct("channel", "row", "col", F.col("normalized").cast("float").alias("v"))))
    return values.groupBy("patch_id", "split").agg(F.transform(ordered, lambda x: x["v"]).alias("tensor"))
