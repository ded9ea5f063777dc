"""Resampling, neighbourhood filters and patch windows over pixel tables.

A pixel table has a row per pixel, keyed by columns that name its grid and by
``row`` and ``col`` counted from 0. Filters work along rows, then along
columns: two shuffles whatever the radius, each row or column of a raster
being a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import ProcessingError


def shapes(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    return pixels.groupBy(*by).agg((F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"))


def _positive(rows: int, cols: int) -> None:
    if rows <= 0 or cols <= 0:
        raise ProcessingError("a target grid needs at least one row and one column")


def _source(target: Column, size: Column, target_size: Column) -> Column:
    """The source index of a target index: no half-pixel centre, by a scale that is a rounded reciprocal."""
    step = F.lit(1.0) / (target_size.cast("double") / size.cast("double"))
    return F.least(F.floor(target * step).cast("int"), size - 1)


def _targets(grids: DataFrame, rows: Column, cols: Column) -> DataFrame:
    """All pixels of the target grids, for ``grids`` with ``height`` and ``width`` of the sources."""
    return grids.withColumn("t_row", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("t_col", F.explode(F.sequence(F.lit(0), cols - 1)))


def nearest_resample(pixels: DataFrame, by: Sequence[str], rows: int, cols: int) -> DataFrame:
    """Every grid on ``rows`` by ``cols`` pixels, each with the values of its nearest source pixel.

    Target pixels are generated from the grid's shape and joined to their
    source by key, so no pixel meets another grid's.
    """
    _positive(rows, cols)
    targets = _targets(shapes(pixels, by), F.lit(rows), F.lit(cols))
    targets = targets.select(*by, "t_row", "t_col", _source(F.col("t_row"), F.col("height"), F.lit(rows)).alias("row"), _source(F.col("t_col"), F.col("width"), F.lit(cols)).alias("col"))
    values = [c for c in pixels.columns if c not in {*by, "row", "col"}]
    return targets.join(pixels, [*by, "row", "col"]).select(*by, F.col("t_row").alias("row"), F.col("t_col").alias("col"), *values)


def bilinear_resample(pixels: DataFrame, by: Sequence[str], rows: int, cols: int, bands: Sequence[str]) -> DataFrame:
    """Every grid on ``rows`` by ``cols`` pixels, by linear interpolation between pixel centres, edges repeated."""
    _positive(rows, cols)

    def along(table: DataFrame, axis: str, size: str, n: int, other: str) -> DataFrame:
        """Interpolate along one axis; each target index takes two source indices."""
        at = (F.col("t") + 0.5) * (F.col(size) / F.lit(float(n))) - 0.5
        at = F.least(F.greatest(at, F.lit(0.0)), (F.col(size) - 1).cast("double"))
        grid = shapes(table, by).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at", at)
        low = F.floor("at").cast("int")
        pairs = F.array(F.struct(low.alias(axis), (1 - (F.col("at") - low)).alias("weight")), F.struct(F.least(low + 1, F.col(size) - 1).alias(axis), (F.col("at") - low).alias("weight")))
        need = grid.select(*by, "t", F.explode(pairs).alias("p")).select(*by, "t", f"p.{axis}", "p.weight")
        sums = [F.sum(F.col(b).cast("double") * F.col("weight")).alias(b) for b in bands]
        return need.join(table, [*by, axis]).groupBy(*by, F.col("t").alias(axis), other).agg(*sums)

    flat = along(pixels.select(*by, "row", "col", *bands), "row", "height", rows, "col")
    return along(flat, "col", "width", cols, "row").select(*by, "row", "col", *bands)


def mean_filter(pixels: DataFrame, by: Sequence[str], bands: Sequence[str], radius: int = 1) -> DataFrame:
    """Adds ``<band>_mean``: the mean of the square window around each pixel, edge pixels repeated outside."""
    if radius < 0:
        raise ProcessingError("a radius is not negative")
    size = 2 * radius + 1

    def total(column: str, window: W) -> Column:
        everything = window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        value = F.struct(F.col(column).cast("double").alias("v"))
        parts = [F.col(column).cast("double")]
        for k in range(1, radius + 1):
            parts.append(F.coalesce(F.lag(value, k).over(window), F.first(value).over(everything))["v"])
            parts.append(F.coalesce(F.lead(value, k).over(window), F.last(value).over(everything))["v"])
        return sum(parts[1:], parts[0])

    across, down = W.partitionBy(*by, "row").orderBy("col"), W.partitionBy(*by, "col").orderBy("row")
    out = pixels.withColumns({f"_{b}": total(b, across) for b in bands})
    return out.withColumns({f"{b}_mean": total(f"_{b}", down) / float(size * size) for b in bands}).drop(*[f"_{b}" for b in bands])


def gaussian_weights(kernel: int) -> list[float]:
    """One row of the kernel: binomial for the small sizes, else sampled from the bell of the customary deviation."""
    if kernel <= 0 or kernel % 2 == 0:
        raise ProcessingError("a kernel size is odd and positive")
    if kernel <= 5:
        return [math.comb(kernel - 1, k) / 2 ** (kernel - 1) for k in range(kernel)]
    if kernel == 7:
        return [x / 32 for x in (1, 3.5, 7, 9, 7, 3.5, 1)]  # fixed values
    deviation = 0.3 * ((kernel - 1) / 2 - 1) + 0.8
    bell = [math.exp(-((k - kernel // 2) ** 2) / (2 * deviation**2)) for k in range(kernel)]
    return [x / sum(bell) for x in bell]


def gaussian_filter(pixels: DataFrame, by: Sequence[str], band: str, kernel: int = 5) -> DataFrame:
    """``by, row, col, <band>_smooth``; outside the raster, pixels are mirrored without repeating the edge."""
    weights = gaussian_weights(kernel)
    half = kernel // 2

    def smooth(values: Column) -> Column:
        n = F.size(values)
        period = F.greatest(2 * (n - 1), F.lit(1))

        def mirrored(i: Column) -> Column:
            inside = F.pmod(i, period)
            return F.when(inside < n, inside).otherwise(period - inside)

        def at(_, i: Column) -> Column:
            parts = [F.get(values, mirrored(i + k - half)) * w for k, w in enumerate(weights)]
            return sum(parts[1:], parts[0])

        return F.transform(values, at)

    def along(table: DataFrame, group: str, axis: str) -> DataFrame:
        lines = table.groupBy(*by, group).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, "v"))), lambda x: x["v"]).alias("line"))
        return lines.select(*by, group, F.posexplode(smooth(F.col("line"))).alias(axis, "v"))

    out = along(pixels.select(*by, "row", "col", F.col(band).cast("double").alias("v")), "row", "col")
    return along(out, "col", "row").select(*by, F.col("row").cast("int"), F.col("col").cast("int"), F.col("v").alias(f"{band}_smooth"))


def window_starts(position: Column, size: Column, window: int, stride: int) -> Column:
    """Starts of the full windows of a line of ``size`` pixels that hold ``position``."""
    last = F.floor((size - window) / stride).cast("int")  # number of the last full window
    first = F.greatest(F.lit(0), F.ceil((position - window + 1) / F.lit(stride)).cast("int"))
    final = F.least(last, F.floor(position / stride).cast("int"))
    return F.when((size >= window) & (first <= final), F.transform(F.sequence(first, F.greatest(first, final)), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))


def patch_pixels(pixels: DataFrame, by: Sequence[str], window: int, stride: int) -> DataFrame:
    """Every pixel once for each full window that holds it: adds ``row0, col0``; rows and columns without one drop out."""
    if window <= 0 or stride <= 0:
        raise ProcessingError("patch size and stride are positive")
    sized = pixels.join(shapes(pixels, by), list(by))
    rows, cols = (window_starts(F.col(c), F.col(s), window, stride) for c, s in (("row", "height"), ("col", "width")))
    return sized.withColumn("row0", F.explode(rows)).withColumn("col0", F.explode(cols)).drop("height", "width")


def pixels_to_tiles(pixels: DataFrame, by: Sequence[str], band: str, tile: int = 256) -> DataFrame:
    """Square tiles of one band with their values in row-major order, for storing large rasters."""
    place = [(F.col(c) / tile).cast("int").alias(f"tile_{c}") for c in ("row", "col")]
    cells = pixels.select(*by, *place, "row", "col", F.col(band).cast("float").alias("v")).groupBy(*by, "tile_row", "tile_col")
    cells = cells.agg(F.array_sort(F.collect_list(F.struct("row", "col", "v"))).alias("cells"))  # at most a tile's pixels
    return cells.select(*by, "tile_row", "tile_col", (F.array_max("cells.row") - F.array_min("cells.row") + 1).alias("h"), (F.array_max("cells.col") - F.array_min("cells.col") + 1).alias("w"), F.lit(band).alias("band"), F.col("cells.v").alias("data"))


def tiles_to_pixels(tiles: DataFrame, by: Sequence[str], tile: int = 256) -> DataFrame:
    cells = tiles.select(*by, "band", "tile_row", "tile_col", "w", F.posexplode("data").alias("i", "value"))
    return cells.select(*by, "band", (F.col("tile_row") * tile + F.floor(F.col("i") / F.col("w"))).cast("int").alias("row"), (F.col("tile_col") * tile + F.col("i") % F.col("w")).cast("int").alias("col"), "value")
