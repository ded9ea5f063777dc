import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.errors import AlignmentError, DatasetError, FeatureError, GraphError, ModelInputError, ProcessingError, SceneError, SequenceError
from fieldweave.operators import align, features, graph, grid, patches, preprocess, temporal, validate
from fieldweave.plans.pipeline import Pipeline
from fieldweave.schemas import NODES
from fieldweave.sources.scenes import from_arrays

assert AlignmentError and GraphError


def grid_of(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r[column]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(0).random((10, 12))


@pytest.fixture(scope="module")
def pixels(spark, image):
    return from_arrays(spark, "s", "optical", "2026-01-01", {"v": image})[1].cache()


def test_nearest(pixels, image):
    out = grid_of(grid.nearest_resample(pixels, ["scene_id"], 5, 24), "v", (5, 24))
    assert np.array_equal(out, image[np.arange(5) * 2][:, np.arange(24) // 2])
    with pytest.raises(ProcessingError):
        grid.nearest_resample(pixels, ["scene_id"], 0, 3)


def test_bilinear_keeps_constants_and_size(spark, pixels, image):
    out = grid_of(grid.bilinear_resample(pixels, ["scene_id"], 10, 12, ["v"]), "v", (10, 12))
    assert np.allclose(out, image)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_mean_filter(pixels, image, radius):
    padded = np.pad(image, radius, mode="edge")
    n = 2 * radius + 1
    want = sum(padded[i : i + 10, j : j + 12] for i in range(n) for j in range(n)) / n**2
    assert np.allclose(grid_of(grid.mean_filter(pixels, ["scene_id"], ["v"], radius), "v_mean", (10, 12)), want)


@pytest.mark.parametrize("kernel", [3, 5, 7, 9])
def test_gaussian_filter(pixels, image, kernel):
    w = np.array(grid.gaussian_weights(kernel))
    assert w.sum() == pytest.approx(1)
    padded = np.pad(image, kernel // 2, mode="reflect")
    want = sum(w[i] * w[j] * padded[i : i + 10, j : j + 12] for i in range(kernel) for j in range(kernel))
    assert np.allclose(grid_of(grid.gaussian_filter(pixels, ["scene_id"], "v", kernel), "v_smooth", (10, 12)), want)


def test_tiles_round_trip(pixels, image):
    back = grid.tiles_to_pixels(grid.pixels_to_tiles(pixels, ["scene_id"], "v", 4), ["scene_id"], 4)
    assert np.allclose(grid_of(back, "value", image.shape), image, atol=1e-6)


def test_modality_guard_and_cloud_reference(spark):
    scenes, _ = from_arrays(spark, "s", "sar", "2026-01-01", {})
    with pytest.raises(Exception, match="modality optical"):
        preprocess.require_modality(scenes, "optical").collect()
    assert preprocess.cloud_reference(["red", "B02"]) == "B02" and preprocess.cloud_reference(["red"]) == "red"


def greedy(optical, radar, days):
    """Pairs by a plain loop, for comparison."""
    used, out = set(), []
    for o_id, o_day, _ in sorted(optical, key=lambda s: (s[1], s[2])):
        best = None
        for s_id, s_day, _ in radar:
            delta = abs((np.datetime64(o_day) - np.datetime64(s_day)).astype(int))
            if s_id not in used and delta <= days and (best is None or delta < best[0]):
                best = (delta, s_id)
        if best:
            used.add(best[1])
            out.append((o_id, best[1], int(best[0])))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_match_a_loop(spark, seed):
    r = np.random.default_rng(seed)
    make = lambda p, n: [(f"{p}{i}", str(np.datetime64("2026-01-01") + int(d)), i) for i, d in enumerate(r.integers(0, 40, n))]
    optical, radar = make("o", 15), make("s", 12)
    frame = lambda rows: spark.createDataFrame(rows, "scene_id string, acquisition_date string, input_ord long")
    assert sorted(tuple(x) for x in align.pairs(frame(optical), frame(radar)).collect()) == greedy(optical, radar, 3)


def test_long_runs_of_dates(spark):
    """One run without a gap: state stays that of a few days."""
    frame = lambda p, shift: spark.range(400).selectExpr(f"concat('{p}', id) AS scene_id", f"CAST(date_add(DATE'2024-01-01', CAST(id * 2 + {shift} AS INT)) AS STRING) AS acquisition_date", "id AS input_ord", "id % 2 AS tile")
    optical, radar = frame("o", 0), frame("s", 1)
    rows = lambda df, tile=None: [(r["scene_id"], r["acquisition_date"], r["input_ord"]) for r in df.orderBy("input_ord").collect() if tile is None or r["tile"] == tile]
    assert sorted(tuple(x) for x in align.pairs(optical, radar).collect()) == greedy(rows(optical), rows(radar), 3)
    by_tile = sorted(tuple(x)[1:] for x in align.pairs(optical, radar, by=("tile",)).collect())
    assert by_tile == sorted(greedy(rows(optical, 0), rows(radar, 0), 3) + greedy(rows(optical, 1), rows(radar, 1), 3))


def test_every_scene_is_in_one_observation(spark):
    schema = "scene_id string, acquisition_date string, input_ord long, crs string, resolution_m double"
    optical = spark.createDataFrame([("A", "2026-01-01", 0, "c", 10.0), ("B", "2026-01-02", 1, "c", 10.0)], schema)
    radar = spark.createDataFrame([("p", "2026-01-02", 0, "c", 10.0), ("q", "2026-02-01", 1, "c", 10.0)], schema)
    out = align.observations(optical, radar).orderBy("ord").collect()
    assert [(r["observation_id"], r["delta_days"]) for r in out] == [("A__p", 1), ("B__optical_only", None), ("q__sar_only", None)]


def test_shapes_must_agree(spark):
    with pytest.raises(ProcessingError):
        from_arrays(spark, "s", "optical", "2026-01-01", {"a": np.zeros((2, 3)), "b": np.zeros((3, 2))})


def test_features_need_red_and_nir(spark, pixels):
    with pytest.raises(FeatureError):
        features.features(pixels.withColumnRenamed("v", "red"), ["scene_id"])
    with pytest.raises(FeatureError):
        features.features(pixels, ["scene_id"])


def test_sequence_fills_gaps(spark):
    means = spark.createDataFrame([("2026-01-01", 1.0, 0), ("2026-01-15", 3.0, 1), ("2026-02-10", 9.0, 2), ("2026-02-10", 7.0, 3)], "acquisition_date string, v double, input_ord long")
    out = temporal.sequence(means, ["v"]).orderBy("step").collect()
    assert [r["features"][0] for r in out] == [1, 2, 5, 5, 7, 0, 0, 0]
    assert [r["mask"] for r in out] == [1, 0, 0, 0, 1, 0, 0, 0]
    assert str(out[-1]["ts"]) == "2026-03-12"
    with pytest.raises(SequenceError):
        temporal.sequence(means, ["v"], length=0)


@pytest.mark.parametrize("k", [None, 3])
def test_edges_match_dense_matrices(spark, k):
    r = np.random.default_rng(5)
    n = 60
    rows = [(i, float(r.random() * 3e4), float(r.random() * 3e4), [float(v) for v in r.normal(size=3)] if i % 9 else [0.0] * 3, [None, "", "c1", "c2"][i % 4], ["loam", None, "clay"][i % 3], float(r.random() * 3000)) for i in range(n)]
    nodes = spark.createDataFrame(rows, NODES)
    x, y, rain = (np.array([q[j] for q in rows]) for j in (1, 2, 6))
    f = np.array([q[3] for q in rows])
    dist = np.hypot(x[:, None] - x, y[:, None] - y)
    same = lambda j: np.array([[bool(a[j]) and a[j] == b[j] for b in rows] for a in rows])
    length = np.linalg.norm(f, axis=1)
    unit = f / np.where(length < 1e-8, 1, length)[:, None]
    cos = np.where((length < 1e-8)[:, None] | (length < 1e-8), 0, unit @ unit.T)
    soil = np.where(same(5), 1.0, np.maximum(0, cos))
    wet = 1 - np.minimum(1, abs(rain[:, None] - rain) / 1000)
    linked = ((dist <= 5000) | same(4) | (soil > 0.8) | (wet > 0.8)) & ~np.eye(n, dtype=bool)
    want = {(a, b) for a, b in zip(*np.nonzero(linked), strict=True)}
    if k:
        want = {(a, b) for a in range(n) for b in sorted((b for b in range(n) if linked[a, b]), key=lambda b: (dist[a, b], b))[:k]}
    out = graph.edges(nodes, k=k).collect()
    assert {(e["src"], e["dst"]) for e in out} == want
    for e in out:
        a, b = e["src"], e["dst"]
        assert (e["distance_m"], e["soil_similarity"], e["rainfall_similarity"]) == pytest.approx((dist[a, b], soil[a, b], wet[a, b]))


@pytest.mark.parametrize("alike", [0.3, 0.8])
def test_cosine_pairs_in_blocks(spark, monkeypatch, alike):
    monkeypatch.setattr(graph, "PIVOTS", 5)
    monkeypatch.setattr(graph, "BLOCK", 16)
    r = np.random.default_rng(8)
    centres = r.normal(size=(9, 6))
    f = np.array([centres[i % 9] + r.normal(size=6) * 0.4 for i in range(200)])
    nodes = spark.createDataFrame([(i, 0.0, 0.0, [float(v) for v in x], None, None, 0.0) for i, x in enumerate(f)] + [(900, 0.0, 0.0, [1.0], None, None, 0.0), (901, 0.0, 0.0, [2.0], None, None, 0.0), (902, 0.0, 0.0, [], None, None, 0.0)], NODES)
    unit = f / np.linalg.norm(f, axis=1)[:, None]
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(unit @ unit.T > alike), strict=True) if a != b} | {(900, 901), (901, 900)}
    out = [tuple(x) for x in graph.cosine_pairs(graph.prepared(nodes), alike).collect()]
    assert len(out) == len(set(out)) and set(out) == want


def test_cosines_at_the_bound_go_by_the_formula(spark):
    """Whole numbers with a cosine of exactly 0.8 or next to it; lengths that are roots."""
    r = np.random.default_rng(3)
    f = [[float(v) for v in x] for x in r.integers(-4, 5, size=(300, 4)) if x.any()]
    nodes = spark.createDataFrame([(i, 0.0, 0.0, x, None, None, 0.0) for i, x in enumerate(f)], NODES)
    cosine = lambda x, y: sum(p * q for p, q in zip(x, y)) / (math.sqrt(sum(p * p for p in x)) * math.sqrt(sum(q * q for q in y)))
    want = {(i, j): cosine(x, y) for i, x in enumerate(f) for j, y in enumerate(f) if i != j}
    assert sum(abs(c - 0.8) < 1e-12 for c in want.values()) > 10
    n = graph.prepared(nodes)
    out = {(e["src"], e["dst"]): e["soil_similarity"] for e in graph.attributes(graph.cosine_pairs(n), n).collect()}
    assert out == {pair: c for pair, c in want.items() if c > 0.8}


def test_vectors_that_are_not_finite_take_no_links_from_others(spark):
    odd = [[float("nan"), 1.0], [float("inf"), 1.0], [1e200, 1.0]]
    nodes = spark.createDataFrame([(i, 0.0, 0.0, x, None, None, 0.0) for i, x in enumerate([[1.0, 0.1], [1.0, 0.2], *odd])], NODES)
    assert {tuple(x) for x in graph.cosine_pairs(graph.prepared(nodes)).collect()} == {(0, 1), (1, 0)}


def test_distances_are_roots_of_squares(spark):
    r = np.random.default_rng(5)
    places = [(float(x), float(y)) for x, y in r.uniform(-300, 300, size=(60, 2)).round(2)] + [(-2e-14, 0.0), (500.0, 0.0)]
    nodes = spark.createDataFrame([(i, x, y, [], None, None, 0.0) for i, (x, y) in enumerate(places)], NODES)
    far = lambda a, b: math.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))
    want = {(i, j): far(a, b) for i, a in enumerate(places) for j, b in enumerate(places) if i != j and far(a, b) <= 500}
    n = graph.prepared(nodes)
    assert (60, 61) in want and {(e["src"], e["dst"]): e["distance_m"] for e in graph.attributes(graph.near_pairs(n, 500.0), n).collect()} == want


def test_nearest_in_blocks_are_those_of_all_pairs(spark, monkeypatch):
    """Small blocks and cells, equal distances, missing attributes and a place that is not finite."""
    r = np.random.default_rng(11)
    nodes = [(i, float(r.integers(0, 40) * 300), float(r.integers(0, 3) * 300), [float(v) for v in r.integers(-2, 3, 3)], str(r.integers(0, 4)), f"s{r.integers(0, 3)}" if i % 5 else None, float(r.integers(0, 30) * 50)) for i in range(120)]
    nodes = spark.createDataFrame([*nodes, (900, float("nan"), 0.0, [1.0, 1.0, 1.0], "1", "s1", 50.0)], NODES)
    every = graph.edges(nodes, threshold=500.0).toPandas()
    every = every[every.distance_m < np.inf].sort_values(["src", "distance_m", "dst"])
    want = {(int(a), int(b)) for a, b in every.groupby("src").head(4)[["src", "dst"]].to_numpy()}
    monkeypatch.setattr(graph, "FEW", 5)
    monkeypatch.setattr(graph, "BLOCK", 16)
    few = graph.same_key_pairs(graph.prepared(nodes), "irrigation_id", 1).count()
    assert few < graph.same_key_pairs(graph.prepared(nodes), "irrigation_id").count() / 2
    out = [(e["src"], e["dst"]) for e in graph.edges(nodes, threshold=500.0, k=4).collect()]
    assert len(out) == len(set(out)) and set(out) == want


def test_no_nodes_no_edges(spark):
    assert graph.edges(spark.createDataFrame([], NODES)).collect() == []
    assert graph.summary(spark.createDataFrame([], NODES), graph.edges(spark.createDataFrame([], NODES))).first()["empty_graph"]


def test_quickstart_nodes_and_missing_rainfall(spark):
    nodes = spark.createDataFrame([(0, 77.59, 12.97, [0.1], "c", "loam", 120.0), (1, 77.61, 13.01, [0.2], "c", "loam", 118.0), (2, 9e6, 9e6, [], None, None, None), (3, -9e6, 9e6, [], None, None, None)], NODES)
    out = {(e["src"], e["dst"]): e for e in graph.edges(nodes).collect()}
    assert out[0, 1]["distance_m"] == pytest.approx(0.04472, abs=1e-5) and out[0, 1]["rainfall_similarity"] == pytest.approx(0.998)
    assert out[2, 3]["rainfall_similarity"] == 1


@pytest.mark.parametrize(("n", "sizes"), [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (2, 0, 1)), (4, (2, 1, 1)), (10, (7, 1, 2)), (20, (14, 3, 3)), (90, (62, 14, 14))])
def test_split_sizes(spark, n, sizes):
    out = spark.range(n).select(patches.split_of(F.col("id"), F.lit(n)).alias("s")).groupBy("s").count().collect()
    got = {r["s"]: r["count"] for r in out}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == sizes


def test_patches_against_numpy(spark):
    r = np.random.default_rng(1)
    bands = {"b": r.random((20, 20)), "a": r.random((20, 20))}
    bands["a"][0:8, 0:8] = bands["b"][0:8, 0:8] = 1.0  # a window of one value
    bands["a"][19, 19] = np.nan
    cube = from_arrays(spark, "s", "optical", "2026-01-01", bands)[1].withColumnRenamed("scene_id", "observation_id")
    numbered, stats, normal = patches.prepare(cube, ["a", "b"], size=8, stride=4)
    stack = np.stack([bands["a"], bands["b"]])
    windows = [stack[:, i : i + 8, j : j + 8] for i in range(0, 13, 4) for j in range(0, 13, 4)]
    valid = [w for w in windows if not np.isnan(w).any() and w.max() > w.min()]
    assert len(windows) == 16 and numbered.count() == len(valid) == 14
    train = np.stack(valid[: int(14 * 0.7)])
    got = {s["channel"]: (s["mean"], s["std"]) for s in stats.collect()}
    for i, c in enumerate("ab"):
        assert got[c] == pytest.approx((train[:, i].mean(), train[:, i].std()))
    tensor = {t["patch_id"]: t["tensor"] for t in patches.tensors(normal).collect()}
    mean, std = np.array([got[c][0] for c in "ab"]), np.array([got[c][1] for c in "ab"])
    assert np.allclose(tensor[3], ((valid[3] - mean[:, None, None]) / std[:, None, None]).ravel(), atol=1e-5)
    with pytest.raises(ModelInputError):
        patches.prepare(cube, ["a"], size=64)


def test_rules(spark):
    scenes = spark.createDataFrame([("s", "optical", "", 0, 0), ("s", "optical", "c", 1, 2)], "scene_id string, modality string, crs string, input_ord long, n_bands long")
    found = validate.report(validate.duplicates(scenes), validate.missing_crs(scenes), validate.missing_bands(scenes), validate.missing_modalities(scenes))
    assert sorted(r["message"] for r in found.collect()) == ["Duplicate scene: s", "Missing CRS for s", "Missing bands for s", "Missing modality: sar"]
    with pytest.raises(DatasetError, match="Duplicate scene"):
        validate.check(found)
    steps = spark.createDataFrame([(0, 0, "2026-01-02"), (0, 1, "2026-01-01"), (0, 2, "2026-01-01")], "sequence_id int, step int, ts string")
    assert {r["rule"] for r in validate.sequences(steps).collect()} == {"not_chronological", "duplicate_timestamps"}
    cubes = spark.createDataFrame([("a", 0, ["x", "y"]), ("b", 1, ["y", "x"]), ("c", 2, ["x", "z"])], "observation_id string, input_ord int, features array<string>")
    assert [r["message"] for r in validate.unlike_features(cubes).collect()] == ["Feature cube c lacks [y] and adds [z]"]
    many = spark.range(150).selectExpr("CAST(id AS STRING) AS scene_id", "'' AS crs")
    with pytest.raises(DatasetError, match="50 more errors"):
        validate.check(validate.missing_crs(many))
    assert validate.empty_cubes(spark.createDataFrame([("o", 0)], "observation_id string, n_features int")).count() == 1


def test_pipeline_pairs(spark):
    r = np.random.default_rng(0)
    o_head, o_pix = from_arrays(spark, "o", "optical", "2026-01-01", {b: r.random((20, 20)) * 3000 for b in ("blue", "green", "red", "nir")}, crs="EPSG:32643", resolution_m=10)
    s_head, s_pix = from_arrays(spark, "s", "sar", "2026-01-02", {"VV": r.random((10, 10)), "VH": r.random((10, 10))}, crs="EPSG:32643", resolution_m=10)
    nodes = spark.createDataFrame([(0, 1.0, 2.0, [0.1, 0.2], "c1", "loam", 100.0), (1, 3.0, 4.0, [0.2, 0.3], "c1", "loam", 110.0)], NODES)
    out = Pipeline(patch=8, stride=8).run(o_head, o_pix, s_head, s_pix, nodes)
    assert len(out.feature_names) == 11 and out.patches.count() == 4 and out.edges.count() == 2
    assert out.observations.first()["observation_id"] == "o__s" and out.sequence.where("mask = 1").count() == 1
    with pytest.raises(SceneError):
        Pipeline().run(o_head.limit(0), o_pix.limit(0), s_head.limit(0), s_pix.limit(0))


def test_pipeline_optical_only(spark):
    r = np.random.default_rng(0)
    head, pix = from_arrays(spark, "o", "optical", "2026-01-01", {b: r.random((16, 16)) * 9999 for b in ("blue", "green", "red", "nir")}, crs="EPSG:4326")
    none, no_pix = from_arrays(spark, "s", "sar", "2026-01-01", {})
    out = Pipeline(patch=8, stride=8).run(head, pix, none.limit(0), no_pix)
    assert len(out.feature_names) == 8 and out.edges.count() == 0 and out.patches.count() == 4 and out.issues.where("rule = 'empty_graph'").count() == 1
