"""The whole preparation of scenes, from raw pixels to model inputs, as one plan per output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SceneError
from ..operators import align, features, graph, patches, preprocess, temporal, validate
from ..schemas import NODES


@dataclass
class Products:
    observations: DataFrame
    cube: DataFrame
    feature_names: list[str]
    sequence: DataFrame
    nodes: DataFrame
    edges: DataFrame
    issues: DataFrame
    patches: DataFrame
    statistics: DataFrame
    normalized: DataFrame


class Pipeline:
    """Optical and radar scenes with their pixels in, :class:`Products` out.

    Parameters that the stages have are parameters here. Observations without
    radar bands have nulls there, and such features; a mix of paired and
    single observations is an error in strict mode, as feature sets differ.
    Without nodes the graph is empty: its tables have no rows, which is noted.
    """

    def __init__(self, *, days: int = align.DAYS, step: int = temporal.STEP, length: int = temporal.LENGTH, patch: int = patches.SIZE, stride: int = patches.STRIDE, near: float = graph.NEAR, k: int | None = None, strict: bool = True):
        self.days, self.step, self.length, self.patch, self.stride, self.near, self.k, self.strict = days, step, length, patch, stride, near, k, strict

    def run(self, optical_scenes: DataFrame, optical_pixels: DataFrame, radar_scenes: DataFrame, radar_pixels: DataFrame, nodes: DataFrame | None = None, report: str | None = None) -> Products:
        first = optical_scenes.orderBy("input_ord").limit(1).collect() or radar_scenes.orderBy("input_ord").limit(1).collect()
        if not first:
            raise SceneError("at least one scene is needed")
        shape = (first[0]["height"], first[0]["width"])
        crs, resolution = first[0]["crs"], first[0]["resolution_m"]
        preprocess.require_modality(optical_scenes, "optical").count()
        preprocess.require_modality(radar_scenes, "sar").count()
        on_grid = lambda scenes: scenes.withColumn("crs", F.lit(crs)).withColumn("resolution_m", F.lit(resolution))
        optical_scenes, radar_scenes = on_grid(optical_scenes), on_grid(radar_scenes)
        bands = lambda p: [c for c in p.columns if c not in ("scene_id", "row", "col", "cloud")]
        o_bands, s_bands = bands(optical_pixels), bands(radar_pixels)
        has = lambda scenes: scenes.limit(1).count() > 0
        o = preprocess.optical(optical_pixels, o_bands, shape=shape) if o_bands else optical_pixels.withColumn("cloud", F.lit(None).cast("boolean"))
        s = preprocess.sar(radar_pixels, s_bands, shape=shape) if s_bands else radar_pixels
        observed = align.observations(optical_scenes, radar_scenes, self.days)
        kinds = {r[0] for r in observed.select("pairing").distinct().collect()}
        if self.strict and len(kinds) > 1:
            raise SceneError(f"observations with different features: {', '.join(sorted(kinds))}")
        used_o = o_bands if has(optical_scenes) else []
        used_s = s_bands if kinds != {"optical_only"} else []
        matched = align.matched_pixels(observed.select("observation_id", "acquisition_date", "optical_scene_id", "sar_scene_id"), o, s, o_bands, s_bands)
        matched = matched.select("observation_id", "acquisition_date", "row", "col", *used_o, *used_s)
        cube = features.features(matched, ["observation_id"], keep=["acquisition_date"])
        names = [c for c in cube.columns if c not in ("observation_id", "acquisition_date", "row", "col")]
        order = observed.select("observation_id", "ord")
        means = features.means(cube, names).join(order, "observation_id")
        sequence = temporal.sequence(means, names, step=self.step, length=self.length, order="ord")
        nodes = optical_scenes.sparkSession.createDataFrame([], NODES) if nodes is None else nodes
        edges = graph.edges(nodes, threshold=self.near, k=self.k)
        scenes = optical_scenes.unionByName(radar_scenes)
        issues = [validate.duplicates(scenes), validate.missing_crs(scenes), validate.clouds(preprocess.cloud_fraction(o)), validate.missing_modalities(scenes)]
        issues.append(validate.sequences(sequence.select(F.lit(0).alias("sequence_id"), "step", "ts")))
        issues += [validate.empty_graph(nodes), validate.edge_integrity(edges, nodes)]
        found = validate.check(validate.report(*issues), report)
        numbered, statistics, normalized = patches.prepare(cube, names, size=self.patch, stride=self.stride)
        return Products(observed, cube, names, sequence, nodes, edges, found, numbered, statistics, normalized)
