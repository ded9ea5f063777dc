"""Similarity graphs over nodes with places, features, areas, soils and rainfall.

Two nodes are linked if they are near, share an irrigation area, or are alike
in soil or rainfall. Places, areas, soils and rainfall are equi-joins: places
by cells of a grid and the cells around, rainfall by bands. Feature vectors
are alike by their angle: they are grouped round pivots, and by the triangle
inequality only groups near enough are compared, in blocks of bounded size by
matrix products that emit nothing but links; what a product leaves in doubt at
the bound is decided by the formula that attributes have. The union of the
pairs is taken once and attributes are computed on it. Where only the nearest
of a node count, large cells are gone through in blocks that emit no more than
those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..errors import GraphError
from ..functions.arithmetic import dot, norm

NEAR, ALIKE = 5000.0, 0.8
ATTRIBUTES = ("distance_m", "shared_irrigation", "soil_similarity", "rainfall_similarity")
#: Pivots of feature vectors at most, and vectors of a block about.
PIVOTS, BLOCK = 64, 1024
#: Up to so many nodes of a cell and around it are joined, more are compared in blocks, if only the nearest count.
FEW = 128
#: How far a cosine of a matrix product may be from that of the formula, by far.
DOUBT = 1e-9


def prepared(nodes: DataFrame) -> DataFrame:
    """Missing places and rainfall are 0; ``length`` is the feature vector's, null if near 0."""
    out = nodes.select(
        "node_id",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("x", "y", "rainfall_mm")],
        *[F.when(F.col(c).cast("string").isin("", "0"), None).otherwise(F.col(c).cast("string")).alias(c) for c in ("irrigation_id", "soil_type")],
        F.coalesce(F.col("features").cast("array<double>"), F.array().cast("array<double>")).alias("features"),
    )
    length = norm(F.col("features"))
    return out.withColumn("length", length).withColumn("length", F.when(F.col("length") >= 1e-8, F.col("length")))


def _distance(p: str, q: str) -> Column:
    """The root of the squares, as SQL would have it; ``hypot`` where those leave the range of doubles."""
    dx, dy = F.col(f"{p}x") - F.col(f"{q}x"), F.col(f"{p}y") - F.col(f"{q}y")
    squares = dx * dx + dy * dy
    return F.when((squares > 1e-290) & (squares < float("inf")), F.sqrt(squares)).otherwise(F.hypot(dx, dy))


def _cells(nodes: DataFrame, coordinates: list[Column], size: float) -> tuple[DataFrame, DataFrame]:
    """Nodes by their cell, and by all cells at most one away in every coordinate."""
    cell = [F.floor(c / size).cast("long") for c in coordinates]
    here = nodes.withColumn("cell", F.array(*cell))
    around = here
    for i in range(len(cell)):
        around = around.withColumn(f"_{i}", F.explode(F.array(*[F.col("cell")[i] + k for k in (-1, 0, 1)])))
    return here, around.withColumn("cell", F.array(*[F.col(f"_{i}") for i in range(len(cell))])).drop(*[f"_{i}" for i in range(len(cell))])


def _pairs(left: DataFrame, right: DataFrame, key: str, condition: Column) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.node_id") != F.col("b.node_id")) & condition).select(F.col("a.node_id").alias("src"), F.col("b.node_id").alias("dst"))


def _distances(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`_distance` of all of ``a`` from all of ``b``."""
    dx, dy = x[a][:, None] - x[b], y[a][:, None] - y[b]
    with np.errstate(over="ignore", invalid="ignore"):
        squares = dx * dx + dy * dy
        out = np.sqrt(squares)
        odd = ~((squares > 1e-290) & (squares < np.inf))
        out[odd] = np.hypot(dx[odd], dy[odd])
    return out


def _closest(rows: pa.Table, one: np.ndarray, two: np.ndarray, linked: np.ndarray, k: int) -> pa.Table:
    """``src, dst``: of each row of ``one`` the ``k`` nearest rows of ``two`` that ``linked`` marks; of equal distances those of smaller ids."""
    ids = rows["node_id"].combine_chunks()
    order = pc.sort_indices(ids.take(pa.array(two, pa.int64()))).to_numpy()
    two, linked = two[order], linked[:, order]
    same = pc.dictionary_encode(ids).indices.to_numpy(zero_copy_only=False)
    far = _distances(rows["x"].to_numpy(), rows["y"].to_numpy(), one, two)
    far[~linked | (same[one][:, None] == same[two]) | ~np.isfinite(far)] = np.inf
    if k < far.shape[1]:
        last = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
        even = far == last
        near = (far < last) | (even & (even.cumsum(1) <= k - (far < last).sum(1)[:, None]))
    else:
        near = np.ones(far.shape, bool)
    x, y = np.nonzero(near & (far < np.inf))
    return pa.table({"src": ids.take(pa.array(one[x], pa.int64())), "dst": ids.take(pa.array(two[y], pa.int64()))})


def _nearest_pairs(left: DataFrame, right: DataFrame, key: str, condition: Column, linked: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray], k: int) -> DataFrame:
    """Pairs as of :func:`_pairs`, of which large cells give no more than each node's ``k`` nearest in each two blocks.

    ``linked`` is the condition on all pairs of two sets of rows.
    """
    kind = left.schema["node_id"].dataType.simpleString()
    left, right = (df.where(F.col("node_id").isNotNull()) for df in (left, right))
    blocks = lambda n: F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(n)
    sizes = left.groupBy(key).agg(blocks("blocks_a")).join(right.groupBy(key).agg(blocks("blocks_b"), (F.count(F.lit(1)) > FEW).alias("many")), key)
    few = _pairs(left.join(sizes.where("NOT many").select(key), key), right, key, condition)
    own = [c for c in left.columns if c != key]
    many = sizes.where("many")
    block = lambda n: F.pmod(F.xxhash64("node_id"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(many, key).select(key, block("blocks_a").alias("i"), other("blocks_b").alias("j"), F.lit(0).alias("side"), *own)
    b = right.join(many, key).select(key, other("blocks_a").alias("i"), block("blocks_b").alias("j"), F.lit(1).alias("side"), *own)

    def compared(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        return _closest(rows, one, two, linked(rows, one, two), k)

    return few.union(a.union(b).groupBy(key, "i", "j").applyInArrow(compared, f"src {kind}, dst {kind}"))


def near_pairs(nodes: DataFrame, threshold: float = NEAR, k: int | None = None) -> DataFrame:
    """Nodes within the threshold; with ``k``, here and below, at least the ``k`` nearest of each, and not all."""
    here, around = _cells(nodes.select("node_id", "x", "y"), [F.col("x"), F.col("y")], threshold * (1 + 1e-9))
    condition = _distance("a.", "b.") <= threshold
    if k is None:
        return _pairs(here, around, "cell", condition)
    return _nearest_pairs(here, around, "cell", condition, lambda rows, a, b: _distances(rows["x"].to_numpy(), rows["y"].to_numpy(), a, b) <= threshold, k)


def same_key_pairs(nodes: DataFrame, key: str, k: int | None = None) -> DataFrame:
    some = nodes.where(F.col(key).isNotNull())
    if k is None:
        return _pairs(some.select("node_id", key), some.select("node_id", key), key, F.lit(True))
    some = some.select("node_id", "x", "y", key)
    return _nearest_pairs(some, some, key, F.lit(True), lambda rows, a, b: np.ones((len(a), len(b)), bool), k)


def rainfall_similarity(a: Column, b: Column) -> Column:
    apart = F.abs(a - b) / 1000.0
    return F.lit(1.0) - F.when(F.isnan(apart), apart).otherwise(F.least(F.lit(1.0), apart))


def rainfall_pairs(nodes: DataFrame, alike: float = ALIKE, k: int | None = None) -> DataFrame:
    some = nodes.where(~F.isnan("rainfall_mm")).select("node_id", "rainfall_mm", *(["x", "y"] if k else []))
    here, around = _cells(some, [F.col("rainfall_mm")], 1000.0 * (1 - alike) * (1 + 1e-9))
    condition = rainfall_similarity(F.col("a.rainfall_mm"), F.col("b.rainfall_mm")) > alike
    if k is None:
        return _pairs(here, around, "cell", condition)

    def linked(rows: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rain = rows["rainfall_mm"].to_numpy()
        return 1.0 - np.minimum(1.0, np.abs(rain[a][:, None] - rain[b]) / 1000.0) > alike

    return _nearest_pairs(here, around, "cell", condition, linked, k)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _cosines(vectors: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosines of pairs, with the roundings of :func:`attributes`: products are added place by place."""
    total = np.zeros(len(a))
    for place in vectors.T:
        total += place[a] * place[b]
    return total / (length[a] * length[b])


def cosine_pairs(nodes: DataFrame, alike: float = ALIKE, k: int | None = None) -> DataFrame:
    """``src, dst``: pairs of feature vectors of one length with a cosine over ``alike``, exact, in both directions.

    Of vectors round two pivots none are alike if the angle between the pivots
    exceeds both groups' greatest angles and that of ``alike``. The driver holds
    the pivots and one angle and count for each. Vectors that are not finite
    are alike to none.
    """
    spark = nodes.sparkSession
    some = nodes.where(F.col("length") < float("inf")).select("node_id", "features", "length", "x", "y", F.size("features").alias("dim"))
    found = [_alike_of(some.where(F.col("dim") == dim), dim, alike, k) for dim in sorted(r[0] for r in some.select("dim").distinct().collect())]
    none = spark.createDataFrame([], T.StructType([T.StructField(c, nodes.schema["node_id"].dataType) for c in ("src", "dst")]))
    return reduce(DataFrame.union, found, none)


def _alike_of(vectors: DataFrame, dim: int, alike: float, k: int | None) -> DataFrame:
    kind = vectors.schema["node_id"].dataType.simpleString()
    pivots = np.array([r["features"] for r in vectors.orderBy(F.xxhash64("node_id"), "node_id").limit(PIVOTS).select("features").collect()], float)
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angle(_vectors(batch.column(1), dim) / batch.column(2).to_numpy()[:, None] @ pivots.T)
            nearest = angles.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(angles[np.arange(len(nearest)), nearest])], ["node_id", "features", "length", "x", "y", "pivot", "angle"])

    own = vectors.select("node_id", "features", "length", "x", "y").mapInArrow(grouped, f"node_id {kind}, features array<double>, length double, x double, y double, pivot int, angle double")
    groups = {r["pivot"]: (r["far"], -(-r["n"] // BLOCK)) for r in own.groupBy("pivot").agg(F.max("angle").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    apart, widest = _angle(pivots @ pivots.T), float(_angle(np.array(alike))) + 1e-6
    meeting = [(a, b, groups[a][1], groups[b][1]) for a in groups for b in groups if a <= b and apart[a, b] <= groups[a][0] + groups[b][0] + widest]
    if not meeting:
        return vectors.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst")).limit(0)
    pairs = F.broadcast(vectors.sparkSession.createDataFrame(meeting, "a int, b int, blocks_a int, blocks_b int"))  # at most the square of PIVOTS
    # a vector's block in its group, and the blocks of the other group that it meets
    block = lambda n: F.pmod(F.xxhash64("node_id"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = own.join(pairs, F.col("pivot") == F.col("a")).select("a", "b", block("blocks_a").alias("i"), other("blocks_b").alias("j"), F.lit(0).alias("side"), "node_id", "features", "length", "x", "y")
    right = own.join(pairs, F.col("pivot") == F.col("b")).select("a", "b", other("blocks_a").alias("i"), block("blocks_b").alias("j"), F.lit(1).alias("side"), "node_id", "features", "length", "x", "y")
    both = left.union(right).where("a < b OR i <= j")

    def compared(key: tuple, rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        vectors, length = _vectors(rows["features"].combine_chunks(), dim), rows["length"].to_numpy()
        unit = vectors / length[:, None]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        cosine = unit[one] @ unit[two].T
        x, y = np.nonzero(cosine > alike - DOUBT)
        sure = cosine[x, y] > alike + DOUBT
        sure[~sure] = _cosines(vectors, length, one[x[~sure]], two[y[~sure]]) > alike
        x, y = x[sure], y[sure]
        apart = key[0].as_py() != key[1].as_py() or key[2].as_py() != key[3].as_py()  # blocks of their own: each pair is here once
        if k is not None:
            linked = np.zeros(cosine.shape, bool)
            linked[x, y] = True
            found = [_closest(rows, one, two, linked, k)]
            return pa.concat_tables([*found, _closest(rows, two, one, linked.T, k)] if apart else found)
        ids = rows["node_id"].combine_chunks()
        first, second = ids.take(pa.array(one[x], pa.int64())), ids.take(pa.array(two[y], pa.int64()))
        if apart:
            first, second = pa.concat_arrays([first, second]), pa.concat_arrays([second, first])
        return pa.table({"src": first, "dst": second}).filter(pc.not_equal(first, second))

    return both.groupBy("a", "b", "i", "j").applyInArrow(compared, f"src {kind}, dst {kind}")


def edges(nodes: DataFrame, *, threshold: float = NEAR, alike: float = ALIKE, k: int | None = None) -> DataFrame:
    """``src, dst`` and the attributes of all linked pairs in both directions, or of the ``k`` nearest of each source.

    Equal distances go to the smaller node. Of the pairs that ``k`` leaves out
    nothing but the distance is computed; each kind of link brings the nearest
    of its own, and the nearest of all are among them. No nodes, no edges.
    """
    if k is not None and k <= 0:
        raise GraphError("k is positive")
    n = prepared(nodes)
    found = near_pairs(n, threshold, k).union(same_key_pairs(n, "irrigation_id", k)).union(same_key_pairs(n, "soil_type", k)).union(rainfall_pairs(n, alike, k)).union(cosine_pairs(n, alike, k)).distinct()
    return attributes(found if k is None else nearest(found, n, k), n)


def nearest(pairs: DataFrame, prepared_nodes: DataFrame, k: int) -> DataFrame:
    """The pairs of each source's ``k`` nearest; those without a finite distance are out."""
    place = lambda p, name: prepared_nodes.select(F.col("node_id").alias(name), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"))
    far = pairs.join(place("a", "src"), "src").join(place("b", "dst"), "dst").select("src", "dst", _distance("a_", "b_").alias("distance"))
    order = W.partitionBy("src").orderBy("distance", "dst")
    finite = ~F.isnan("distance") & (F.col("distance") < float("inf"))
    return far.where(finite).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("src", "dst")


def attributes(pairs: DataFrame, prepared_nodes: DataFrame) -> DataFrame:
    side = lambda p, name: prepared_nodes.select(F.col("node_id").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in prepared_nodes.columns if c != "node_id"])
    both = pairs.join(side("a", "src"), "src").join(side("b", "dst"), "dst")
    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    lengths = F.col("a_length") * F.col("b_length")  # null if one is near 0
    cosine = F.when(lengths.isNotNull() & (F.size("a_features") == F.size("b_features")), F.greatest(F.lit(0.0), dot(F.col("a_features"), F.col("b_features")) / lengths)).otherwise(0.0)
    return both.select(
        "src",
        "dst",
        _distance("a_", "b_").alias("distance_m"),
        same("irrigation_id").cast("double").alias("shared_irrigation"),
        F.when(same("soil_type"), F.lit(1.0)).otherwise(cosine).alias("soil_similarity"),
        rainfall_similarity(F.col("a_rainfall_mm"), F.col("b_rainfall_mm")).alias("rainfall_similarity"),
    )


def summary(nodes: DataFrame, linked: DataFrame, *, threshold: float = NEAR, k: int | None = None) -> DataFrame:
    """The graph's metadata, one row."""
    counts = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node_count").alias("what"), "n").union(linked.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge_count"), "n"))
    both = counts.groupBy().agg(*[F.max(F.when(F.col("what") == c, F.col("n"))).alias(c) for c in ("node_count", "edge_count")])
    both = both.withColumn("empty_graph", F.col("node_count") == 0)
    return both.withColumn("edge_attributes", F.array(*[F.lit(a) for a in ATTRIBUTES])).withColumn("format", F.lit("pytorch_geometric")).withColumn("k_neighbors", F.lit(k).cast("int")).withColumn("proximity_threshold_m", F.lit(float(threshold)))
