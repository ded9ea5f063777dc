"""One query per operator over projected scenes, and the same in SQL."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import functions as fn
from ..operators import align, features, graph, grid, normalize, patches, preprocess, temporal, validate
from ..sources import artifacts, catalog, config, export, scenes
from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PX = """px AS (SELECT event_id // 400 AS scene, CAST((event_id % 400) // 20 AS INTEGER) AS "row", CAST(event_id % 20 AS INTEGER) AS col, value * 20::DOUBLE AS red,
  CAST((event_id * 37 + user_id * 11) % 10001 AS DOUBLE) AS nir, CAST((event_id * 53 + 7) % 10001 AS DOUBLE) AS green, CAST((event_id * 71 + user_id) % 10001 AS DOUBLE) AS blue,
  CAST((event_id * 17 + 3) % 10001 AS DOUBLE) AS swir, value / 245::DOUBLE AS vv, CAST((event_id * 29) % 1000 AS DOUBLE) / 500::DOUBLE AS vh FROM events)"""
#: Reflectance, clouds and backscatter of every pixel.
RX = PX + """, rx AS (SELECT scene, "row", col, least(greatest(red * 0.0001::DOUBLE, 0), 1) AS red, least(greatest(nir * 0.0001::DOUBLE, 0), 1) AS nir, least(greatest(green * 0.0001::DOUBLE, 0), 1) AS green,
  least(greatest(blue * 0.0001::DOUBLE, 0), 1) AS blue, least(greatest(blue * 0.0001::DOUBLE, 0), 1) > 0.4::DOUBLE AS cloud, 10 * log10(greatest(vv, 0.000001::DOUBLE)) AS vv, 10 * log10(greatest(vh, 0.000001::DOUBLE)) AS vh FROM px)"""
SCENES = """sc AS (SELECT DISTINCT event_id // 400 AS scene FROM events), scenes AS (SELECT CAST(scene AS VARCHAR) AS scene_id, CASE WHEN scene % 2 = 0 THEN 'optical' ELSE 'sar' END AS modality,
  DATE '2024-01-01' + CAST(scene * 2 AS INTEGER) AS day, CASE WHEN scene % 11 = 10 THEN '' ELSE 'EPSG:32643' END AS crs, scene AS input_ord FROM sc)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def nd(a: str, b: str) -> str:
    return f"({a} - {b}) / {guard(f'({a} + {b})')}"


def guard(d: str) -> str:
    return f"CASE WHEN abs({d}) < 1e-6::DOUBLE THEN CASE WHEN {d} >= 0 THEN 1e-6::DOUBLE ELSE -1e-6::DOUBLE END ELSE {d} END"


def rnd(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


def mean3(band: str, radius: int = 1) -> str:
    """The windowed mean of a band with repeated edges, as a correlated lookup over clamped places."""
    return f"""(SELECT p.scene, p."row", p.col, avg(q.{band}) AS m FROM rx p CROSS JOIN range(-{radius}, {radius + 1}) i(dr) CROSS JOIN range(-{radius}, {radius + 1}) j(dc)
  JOIN hw ON hw.scene = p.scene JOIN rx q ON q.scene = p.scene AND q."row" = least(greatest(p."row" + dr, 0), h - 1) AND q.col = least(greatest(p.col + dc, 0), w - 1) GROUP BY ALL)"""


HW = """hw AS (SELECT scene, max("row") + 1 AS h, max(col) + 1 AS w FROM px GROUP BY scene)"""


def optical(spark: SparkSession, sf_dir: str, shape=None) -> DataFrame:
    return preprocess.optical(fx.pixels(spark, sf_dir).drop("vv", "vh"), fx.OPTICAL, by=["scene"], shape=shape)


def reflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflectance, clouds and decibels without speckle filtering."""
    px = optical(spark, sf_dir)
    radar = fx.pixels(spark, sf_dir).select("scene", "row", "col", *[fn.decibels(F.col(b)).alias(b) for b in fx.RADAR])
    return px.join(radar, ["scene", "row", "col"])


def place(*extra) -> list:
    return ["scene", "row", "col", *extra]


# Arithmetic


@query(f'WITH {PX} SELECT scene, "row", col, {rnd("least(greatest(red * 0.0002::DOUBLE - 0.5::DOUBLE, 0), 1)")} AS v FROM px')
def scale_clip(spark, d):
    return fx.pixels(spark, d).select(*place(r6(fn.clip(fn.scale(F.col("red"), 0.0002, -0.5), 0, 1)).alias("v")))


@query(f'WITH {RX} SELECT scene, "row", col, {rnd("red")} AS red, {rnd("nir")} AS nir, {rnd("green")} AS green, {rnd("blue")} AS blue FROM rx')
def reflectance_chain(spark, d):
    return optical(spark, d).select(*place(*[r6(b).alias(b) for b in ("red", "nir", "green", "blue")]))


@query(f'WITH {RX} SELECT scene, "row", col, cloud FROM rx')
def cloud_mask(spark, d):
    return optical(spark, d).select(*place("cloud"))


@query(f"WITH {RX} SELECT scene, {rnd('avg(CAST(cloud AS INTEGER))')} AS cloud_fraction FROM rx GROUP BY scene")
def cloud_fraction(spark, d):
    return preprocess.cloud_fraction(optical(spark, d), ["scene"]).select("scene", r6("cloud_fraction").alias("cloud_fraction"))


@query(f'WITH {RX} SELECT scene, "row", col, {rnd("vv")} AS vv, {rnd("vh")} AS vh FROM rx')
def to_db(spark, d):
    return fx.pixels(spark, d).select(*place(*[r6(fn.decibels(F.col(b))).alias(b) for b in fx.RADAR]))


@query(f'WITH {RX}, {HW}, a AS {mean3("vv")}, b AS {mean3("vh")} SELECT a.scene, a."row", a.col, {rnd("a.m", 5)} AS vv, {rnd("b.m", 5)} AS vh FROM a JOIN b USING (scene, "row", col)')
def sar_chain(spark, d):
    px = fx.pixels(spark, d).select(*place("vv", "vh"))
    return preprocess.sar(px, fx.RADAR, by=["scene"]).select(*place(*[r6(b, 5).alias(b) for b in fx.RADAR]))


@query(f'WITH {PX} SELECT scene, "row", col, {rnd("vh / " + guard("(vv - 1)"))} AS v FROM px')
def safe_ratio(spark, d):
    return fx.pixels(spark, d).select(*place(r6(fn.safe_ratio(F.col("vh"), F.col("vv") - 1)).alias("v")))


@query(f'WITH {PX} SELECT scene, "row", col, {rnd(nd("nir", "swir"))} AS v FROM px')
def normalized_difference(spark, d):
    return fx.pixels(spark, d).select(*place(r6(fn.normalized_difference(F.col("nir"), F.col("swir"))).alias("v")))


@query(f'WITH {PX} SELECT scene, "row", col, {rnd("CASE WHEN max(red) OVER w = min(red) OVER w THEN 0 ELSE (red - min(red) OVER w) / (max(red) OVER w - min(red) OVER w) END")} AS v FROM px WINDOW w AS (PARTITION BY scene)')
def minmax_norm(spark, d):
    return normalize.minmax_normalize(fx.pixels(spark, d), "red", ["scene"]).select(*place(r6("normalized").alias("v")))


@query(f'WITH {PX} SELECT scene, "row", col, {rnd("(nir - avg(nir) OVER w) / stddev_pop(nir) OVER w")} AS v FROM px WINDOW w AS (PARTITION BY scene)')
def zscore_norm(spark, d):
    return normalize.zscore_normalize(fx.pixels(spark, d), "nir", ["scene"]).select(*place(r6("normalized").alias("v")))


_PARTS = """parts AS (SELECT scene, CASE WHEN i < greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train' WHEN i < greatest(greatest(1, floor(n * 0.7::DOUBLE)), floor(n * 0.85::DOUBLE)) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT scene, row_number() OVER (ORDER BY scene) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT scene FROM px)))"""


@query(f"""WITH {PX}, {_PARTS}, s AS (SELECT avg(nir) AS m, stddev_pop(nir) AS d FROM px JOIN parts USING (scene) WHERE split = 'train') SELECT scene, "row", col, {rnd("(nir - m) / d")} AS v FROM px, s""")
def standardize_train(spark, d):
    px = fx.pixels(spark, d)
    index = px.select("scene").distinct().withColumn("index", F.row_number().over(W.orderBy("scene")).cast("long") - 1)  # a row per scene
    train = index.join(patches.splits(index), "index").where("split = 'train'").select("scene")
    stats = px.join(train, "scene").agg(F.avg("nir").alias("m"), F.stddev_pop("nir").alias("s"))
    return px.select(*place(r6(fn.standardize(F.col("nir"), stats.select("m").scalar(), stats.select("s").scalar())).alias("v")))


@query(f"""WITH {PX} SELECT scene, "row", col, CAST(CAST(red AS FLOAT) AS DOUBLE) AS single, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one FROM px""")
def single_precision(spark, d):
    as_double = lambda c, name: c.cast("double").alias(name)
    return fx.pixels(spark, d).select(*place(as_double(fn.as_float("red"), "single"), as_double(fn.zeros_like("red"), "zero"), as_double(fn.ones_like("red"), "one")))


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], e0) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e0, e0))), 6) + 0.0::DOUBLE AS v
  FROM embeddings, (SELECT embedding::DOUBLE[] AS e0 FROM embeddings WHERE vec_id = 0)""")
def cosine_to_first(spark, d):
    vectors = fx.load(spark, d, "embeddings")
    first = vectors.where("vec_id = 0").select(F.first("embedding")).scalar()
    return vectors.withColumn("e0", first).select("vec_id", r6(fn.cosine_similarity(F.col("embedding"), F.col("e0"))).alias("v"))


# Grids


def _nearest(band: str, n: int) -> str:
    return f"""WITH {PX}, {HW}, t AS (SELECT scene, tr."row", tc.col, least(CAST(floor(tr."row" * (1::DOUBLE / ({n}::DOUBLE / h))) AS INTEGER), h - 1) AS sr, least(CAST(floor(tc.col * (1::DOUBLE / ({n}::DOUBLE / w))) AS INTEGER), w - 1) AS sc_
  FROM hw, (SELECT CAST(range AS INTEGER) AS "row" FROM range({n})) tr, (SELECT CAST(range AS INTEGER) AS col FROM range({n})) tc)
  SELECT t.scene, t."row", t.col, {band} AS v FROM t JOIN px ON px.scene = t.scene AND px."row" = sr AND px.col = sc_"""


@query(_nearest("red", 7))
def nearest_resample(spark, d):
    return grid.nearest_resample(fx.pixels(spark, d).select(*place("red")), ["scene"], 7, 7).select(*place(F.col("red").alias("v")))


@query(f"""WITH {PX}, {HW}, r AS (SELECT scene, t AS "row", CAST(floor(pos) AS INTEGER) AS lo, least(CAST(floor(pos) AS INTEGER) + 1, h - 1) AS hi, pos - floor(pos) AS f FROM (SELECT scene, h, CAST(range AS INTEGER) AS t, least(greatest((range + 0.5::DOUBLE) * (h / 9::DOUBLE) - 0.5::DOUBLE, 0), h - 1) AS pos FROM hw, range(9))),
  c AS (SELECT scene, t AS col, CAST(floor(pos) AS INTEGER) AS lo, least(CAST(floor(pos) AS INTEGER) + 1, w - 1) AS hi, pos - floor(pos) AS f FROM (SELECT scene, w, CAST(range AS INTEGER) AS t, least(greatest((range + 0.5::DOUBLE) * (w / 13::DOUBLE) - 0.5::DOUBLE, 0), w - 1) AS pos FROM hw, range(13)))
  SELECT r.scene, r."row", c.col, {rnd('a.red * (1 - r.f) * (1 - c.f) + b.red * r.f * (1 - c.f) + x.red * (1 - r.f) * c.f + y.red * r.f * c.f', 5)} AS v FROM r JOIN c ON r.scene = c.scene
  JOIN px a ON a.scene = r.scene AND a."row" = r.lo AND a.col = c.lo JOIN px b ON b.scene = r.scene AND b."row" = r.hi AND b.col = c.lo
  JOIN px x ON x.scene = r.scene AND x."row" = r.lo AND x.col = c.hi JOIN px y ON y.scene = r.scene AND y."row" = r.hi AND y.col = c.hi""")
def bilinear_resample(spark, d):
    return grid.bilinear_resample(fx.pixels(spark, d), ["scene"], 9, 13, ["red"]).select(*place(r6("red", 5).alias("v")))


def _mean_sql(radius: int) -> str:
    return f'WITH {RX}, {HW}, a AS {mean3("nir", radius)} SELECT scene, "row", col, {rnd("m")} AS v FROM a'


@query(_mean_sql(1))
def mean_filter_r1(spark, d):
    return grid.mean_filter(optical(spark, d), ["scene"], ["nir"], 1).select(*place(r6("nir_mean").alias("v")))


@query(_mean_sql(2))
def mean_filter_r2(spark, d):
    return grid.mean_filter(optical(spark, d), ["scene"], ["nir"], 2).select(*place(r6("nir_mean").alias("v")))


@query(f"""WITH {RX}, {HW}, k(o, wt) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
  a AS (SELECT p.scene, p."row", p.col, sum(q.nir * i.wt * j.wt) / 256 AS m FROM rx p CROSS JOIN k i CROSS JOIN k j JOIN hw ON hw.scene = p.scene
  JOIN rx q ON q.scene = p.scene AND q."row" = CASE WHEN abs(p."row" + i.o) > h - 1 THEN 2 * (h - 1) - (p."row" + i.o) ELSE abs(p."row" + i.o) END AND q.col = CASE WHEN abs(p.col + j.o) > w - 1 THEN 2 * (w - 1) - (p.col + j.o) ELSE abs(p.col + j.o) END GROUP BY ALL)
  SELECT scene, "row", col, {rnd("m", 12)} AS v FROM a""")
def gaussian_k5(spark, d):
    return grid.gaussian_filter(optical(spark, d), ["scene"], "nir", 5).select(*place(r6("nir_smooth", 12).alias("v")))


_TILE = "CAST(floor(\"row\" / 8) AS INTEGER) AS tile_row, CAST(floor(col / 8) AS INTEGER) AS tile_col"


@query(f"""WITH {PX}, t AS (SELECT scene, {_TILE}, "row", col, CAST(CAST(red AS FLOAT) AS DOUBLE) AS v FROM px)
  SELECT scene, tile_row, tile_col, CAST(max("row") - min("row") + 1 AS INTEGER) AS h, CAST(max(col) - min(col) + 1 AS INTEGER) AS w, arg_min(v, "row" * 1000 + col) AS first, arg_max(v, "row" * 1000 + col) AS last, {rnd("sum(v)", 2)} AS total FROM t GROUP BY ALL""")
def tiles(spark, d):
    out = grid.pixels_to_tiles(fx.pixels(spark, d), ["scene"], "red", 8)
    values = F.transform("data", lambda v: v.cast("double"))
    return out.select("scene", "tile_row", "tile_col", "h", "w", F.element_at(values, 1).alias("first"), F.element_at(values, -1).alias("last"), r6(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


@query(f"""WITH {RX}, {HW}, t AS (SELECT scene, tr."row", tc.col, least(CAST(floor(tr."row" * (1::DOUBLE / (7::DOUBLE / h))) AS INTEGER), h - 1) AS sr, least(CAST(floor(tc.col * (1::DOUBLE / (9::DOUBLE / w))) AS INTEGER), w - 1) AS sc_
  FROM hw, (SELECT CAST(range AS INTEGER) AS "row" FROM range(7)) tr, (SELECT CAST(range AS INTEGER) AS col FROM range(9)) tc)
  SELECT t.scene, t."row", t.col, cloud FROM t JOIN rx ON rx.scene = t.scene AND rx."row" = sr AND rx.col = sc_""")
def mask_resample(spark, d):
    return optical(spark, d, shape=(7, 9)).select(*place("cloud"))


@query(f"""WITH {PX} SELECT scene, count(*) AS n_pixels, {rnd("min(red)")} AS red_min, {rnd("avg(red)")} AS red_mean, {rnd("max(red)")} AS red_max, {rnd("avg(vh)")} AS vh_mean FROM px GROUP BY scene""")
def scene_summary(spark, d):
    header = fx.scenes(spark, d)
    px = fx.pixels(spark, d).withColumn("scene_id", F.col("scene").cast("string")).drop("scene")
    out = scenes.describe(header, px)
    return out.select(F.col("input_ord").alias("scene"), "n_pixels", *[r6(c).alias(c) for c in ("red_min", "red_mean", "red_max", "vh_mean")])


# Features

_EVI = "2.5::DOUBLE * (nir - red) / (CASE WHEN abs(nir + 6 * red - 7.5::DOUBLE * blue + 1) < 1e-6::DOUBLE THEN 1e-6::DOUBLE ELSE nir + 6 * red - 7.5::DOUBLE * blue + 1 END)"
_FEATURES = {
    "ndvi": nd("nir", "red"),
    "evi": _EVI,
    "ndwi": nd("green", "nir"),
    "savi": "1.5::DOUBLE * (nir - red) / (nir + red + 0.5::DOUBLE)",
    "gci": f"nir / {guard('green')}",
    "texture_entropy": "-nir * ln(greatest(nir, 1e-6::DOUBLE))",
}


def _pixel_feature(name: str, make):
    def run(spark, d):
        return optical(spark, d).select(*place(r6(make(F.col), 5).alias("v")))

    run.__name__ = name
    query(f'WITH {RX} SELECT scene, "row", col, {rnd(_FEATURES[name], 5)} AS v FROM rx')(run)


_pixel_feature("ndvi", lambda c: fn.ndvi(c("nir"), c("red")))
_pixel_feature("evi", lambda c: fn.evi(c("nir"), c("red"), c("blue")))
_pixel_feature("ndwi", lambda c: fn.ndwi(c("green"), c("nir")))
_pixel_feature("savi", lambda c: fn.savi(c("nir"), c("red")))
_pixel_feature("gci", lambda c: fn.gci(c("nir"), c("green")))
_pixel_feature("texture_entropy", lambda c: fn.entropy(c("nir")))


def _cube(spark, d) -> DataFrame:
    return features.features(reflected(spark, d).withColumnRenamed("vv", "VV").withColumnRenamed("vh", "VH"), ["scene"])


@query(f'WITH {RX}, {HW}, a AS {mean3("nir")} SELECT scene, "row", col, {rnd("abs(nir - m)")} AS v FROM rx JOIN a USING (scene, "row", col)')
def texture_contrast(spark, d):
    return _cube(spark, d).select(*place(r6("texture_contrast").alias("v")))


@query(f'WITH {RX}, {HW}, a AS {mean3("nir")} SELECT scene, "row", col, {rnd("1 / (1 + abs(nir - m))")} AS v FROM rx JOIN a USING (scene, "row", col)')
def texture_homogeneity(spark, d):
    return _cube(spark, d).select(*place(r6("texture_homogeneity").alias("v")))


@query(f'WITH {RX} SELECT scene, "row", col, {rnd("vh / " + guard("vv"), 4)} AS v FROM rx')
def vh_vv_ratio(spark, d):
    return _cube(spark, d).select(*place(r6("vh_vv_ratio", 4).alias("v")))


@query(f"""WITH {RX}, {HW}, a AS {mean3("nir")} SELECT scene, "row", col, {", ".join(f"{rnd(x, 4)} AS {n}" for n, x in _FEATURES.items())}, {rnd("abs(nir - m)", 4)} AS texture_contrast,
  {rnd("1 / (1 + abs(nir - m))", 4)} AS texture_homogeneity, {rnd("vv", 4)} AS vv, {rnd("vh", 4)} AS vh, {rnd("vh / " + guard("vv"), 4)} AS vh_vv_ratio FROM rx JOIN a USING (scene, "row", col)""")
def feature_cube(spark, d):
    cube = _cube(spark, d)
    return cube.select(*place(*[r6(c, 4).alias(c) for c in cube.columns if c not in place()]))


@query(f"""WITH {RX} SELECT scene, {rnd("avg(" + _FEATURES["ndvi"] + ")")} AS ndvi, {rnd("avg(" + _FEATURES["savi"] + ")")} AS savi FROM rx GROUP BY scene""")
def scene_feature_mean(spark, d):
    return features.means(_cube(spark, d), ["ndvi", "savi"], ["scene"]).select("scene", r6("ndvi").alias("ndvi"), r6("savi").alias("savi"))


# Alignment

_FOLD = f"""{SCENES}, o AS (SELECT scene_id, day, row_number() OVER (ORDER BY CAST(day AS VARCHAR), input_ord) AS n FROM scenes WHERE modality = 'optical'), s AS (SELECT * FROM scenes WHERE modality = 'sar'),
  fold AS (SELECT CAST(0 AS BIGINT) AS n, []::VARCHAR[] AS used, CAST(NULL AS VARCHAR) AS o_id, CAST(NULL AS VARCHAR) AS s_id, CAST(NULL AS BIGINT) AS delta
  UNION ALL SELECT o.n, CASE WHEN c.pick IS NULL THEN fold.used ELSE list_append(fold.used, c.pick.s_id) END, o.scene_id, c.pick.s_id, c.pick.delta FROM fold JOIN o ON o.n = fold.n + 1,
  LATERAL (SELECT min(struct_pack(delta := abs(date_diff('day', s.day, o.day)), ord := s.input_ord, s_id := s.scene_id)) AS pick FROM s WHERE abs(date_diff('day', s.day, o.day)) <= 3 AND NOT list_contains(fold.used, s.scene_id)) c)"""


def _headers(spark, d):
    all_scenes = fx.scenes(spark, d)
    return all_scenes.where("modality = 'optical'"), all_scenes.where("modality = 'sar'")


@query(f"WITH RECURSIVE {_FOLD} SELECT o_id AS optical_scene_id, s_id AS sar_scene_id, CAST(delta AS INTEGER) AS delta_days FROM fold WHERE s_id IS NOT NULL")
def align_pairs(spark, d):
    return align.pairs(*_headers(spark, d))


@query(f"""WITH RECURSIVE {_FOLD} SELECT concat(o_id, '__', coalesce(s_id, 'optical_only')) AS observation_id, CASE WHEN s_id IS NULL THEN 'optical_only' ELSE 'optical_sar' END AS pairing, coalesce(CAST(delta AS INTEGER), -1) AS delta_days FROM fold WHERE n > 0
  UNION ALL SELECT concat(scene_id, '__sar_only'), 'sar_only', -1 FROM s WHERE scene_id NOT IN (SELECT s_id FROM fold WHERE s_id IS NOT NULL)""")
def align_full(spark, d):
    return align.observations(*_headers(spark, d)).select("observation_id", "pairing", F.coalesce("delta_days", F.lit(-1)).alias("delta_days"))


def _near(i: str, n: str, m: str) -> str:
    """The place of ``i`` of ``m`` on a grid of ``n``."""
    return f"least(CAST(floor({i} * (1::DOUBLE / ({m}::DOUBLE / {n}))) AS INTEGER), {n} - 1)"


@query(f"""WITH {PX}, opt AS (SELECT scene, "row", col, red FROM px WHERE scene % 2 = 0 AND scene + 1 IN (SELECT scene FROM px)), sar AS (SELECT scene, CAST("row" / 2 AS INTEGER) AS "row", col, vv FROM px WHERE scene % 2 = 1 AND "row" % 2 = 0)
  SELECT opt.scene, opt."row", opt.col, {rnd("red")} AS red, {rnd("vv")} AS vv FROM opt JOIN sar ON sar.scene = opt.scene + 1 AND sar."row" = {_near('opt."row"', "10", "20")} AND sar.col = {_near("opt.col", "20", "20")}
  WHERE opt.scene IN (SELECT scene FROM px GROUP BY scene HAVING count(*) = 400) AND opt.scene + 1 IN (SELECT scene FROM px GROUP BY scene HAVING count(*) = 400)""")
def grid_match(spark, d):
    """Radar of half as many rows on the grid of the optical scene before it."""
    px = fx.pixels(spark, d)
    whole = px.groupBy("scene").count().where("count = 400").select("scene")
    px = px.join(whole, "scene").withColumn("scene_id", F.col("scene").cast("string"))
    pair = whole.where("scene % 2 = 0").join(whole.select((F.col("scene") - 1).alias("scene")), "scene")
    observed = pair.select(F.col("scene").cast("string").alias("observation_id"), F.lit("2024-01-01").alias("acquisition_date"), F.col("scene").cast("string").alias("optical_scene_id"), (F.col("scene") + 1).cast("string").alias("sar_scene_id"))
    seen = px.where("scene % 2 = 0").select("scene_id", "row", "col", "red")
    radar = px.where("scene % 2 = 1 AND row % 2 = 0").select("scene_id", (F.col("row") / 2).cast("int").alias("row"), "col", "vv")
    out = align.matched_pixels(observed, seen, radar, ["red"], ["vv"])
    return out.select(F.col("observation_id").cast("long").alias("scene"), "row", "col", r6("red").alias("red"), r6("vv").alias("vv"))


# Sequences


def _scene_means(spark, d) -> DataFrame:
    """All scenes, with uneven days between them."""
    means = features.means(_cube(spark, d), ["ndvi", "evi"], ["scene"])
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("scene") * 3 + F.col("scene") % 3).cast("int")).cast("string")
    return means.withColumn("acquisition_date", day).withColumnRenamed("scene", "input_ord")


_VECTORS = f"""{RX}, m AS (SELECT scene, avg({_FEATURES["ndvi"]}) AS ndvi, avg({_EVI}) AS evi, DATE '2024-01-01' + CAST(scene * 3 + scene % 3 AS INTEGER) AS day FROM rx GROUP BY scene),
  t AS (SELECT CAST(range AS INTEGER) AS step, (SELECT min(day) FROM m) + CAST(range * 10 AS INTEGER) AS ts FROM range(8))"""


@query(f"WITH {_VECTORS} SELECT step, CAST(ts AS VARCHAR) AS ts, CAST(CASE WHEN EXISTS (SELECT 1 FROM m WHERE day = ts) THEN 1 ELSE 0 END AS BIGINT) AS mask FROM t")
def temporal_timeline(spark, d):
    return temporal.sequence(_scene_means(spark, d), ["ndvi", "evi"]).select("step", F.col("ts").cast("string").alias("ts"), "mask")


_FILLED = "CASE WHEN ts > (SELECT max(day) FROM m) THEN 0 ELSE coalesce((SELECT {f} FROM m WHERE day = ts), ((SELECT arg_max({f}, day) FROM m WHERE day < ts) + (SELECT arg_min({f}, day) FROM m WHERE day > ts)) / 2) END"


@query(f"WITH {_VECTORS} SELECT step, {rnd(_FILLED.format(f='evi'))} AS evi, {rnd(_FILLED.format(f='ndvi'))} AS ndvi FROM t")
def temporal_sequence(spark, d):
    out = temporal.sequence(_scene_means(spark, d), ["ndvi", "evi"])
    return out.select("step", r6(F.col("features")[0]).alias("evi"), r6(F.col("features")[1]).alias("ndvi"))


_GROUPED = f"""{RX}, m AS (SELECT scene % 3 AS field, avg({_FEATURES["ndvi"]}) AS ndvi, DATE '2024-01-01' + CAST(scene * 3 + scene % 3 AS INTEGER) AS day FROM rx GROUP BY scene),
  b AS (SELECT field, min(day) AS first, max(day) AS last FROM m GROUP BY field), t AS (SELECT field, last, CAST(range AS INTEGER) AS step, first + CAST(range * 6 AS INTEGER) AS ts FROM b, range(5))"""


@query(f"""WITH {_GROUPED} SELECT t.field, step, CAST(ts AS VARCHAR) AS ts, CAST(CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.field = t.field AND day = ts) THEN 1 ELSE 0 END AS BIGINT) AS mask,
  {rnd("CASE WHEN ts > last THEN 0 ELSE coalesce((SELECT ndvi FROM m WHERE m.field = t.field AND day = ts), ((SELECT arg_max(ndvi, day) FROM m WHERE m.field = t.field AND day < ts) + (SELECT arg_min(ndvi, day) FROM m WHERE m.field = t.field AND day > ts)) / 2) END")} AS ndvi FROM t""")
def temporal_groups(spark, d):
    """A sequence for each of three fields."""
    means = _scene_means(spark, d).withColumn("field", F.col("input_ord") % 3)
    out = temporal.sequence(means, ["ndvi"], step=6, length=5, by=["field"])
    return out.select("field", "step", F.col("ts").cast("string").alias("ts"), "mask", r6(F.col("features")[0]).alias("ndvi"))


# Graphs

_NODES = """v AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_suppkey AS DOUBLE) AS y, s_nationkey AS k, abs(s_acctbal) AS rain, CASE WHEN s_suppkey % 7 > 0 THEN concat('soil', s_suppkey % 23) END AS soil,
  CASE WHEN s_suppkey % 9 = 0 THEN [0, 0, 0, 0]::DOUBLE[] ELSE [s_suppkey * 7 % 13 - 6, s_suppkey * 5 % 11 - 5, s_suppkey * 3 % 17 - 8, s_suppkey % 19 - 9]::DOUBLE[] END AS f FROM supplier),
  n AS (SELECT *, sqrt(list_dot_product(f, f)) AS len FROM v)"""
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_RAIN = "(1 - least(1, abs(a.rain - b.rain) / 1000::DOUBLE))"


@query(f"WITH {_NODES} SELECT a.id AS src, b.id AS dst, {rnd(_DIST, 4)} AS distance_m FROM n a JOIN n b ON a.id <> b.id AND {_DIST} <= 500")
def graph_distance(spark, d):
    n = graph.prepared(fx.supplier_nodes(spark, d))
    return graph.attributes(graph.near_pairs(n, 500.0), n).select("src", "dst", r6("distance_m", 4).alias("distance_m"))


@query(f"WITH {_NODES} SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON a.id <> b.id AND a.k = b.k AND a.k <> 0")
def graph_shared_key(spark, d):
    return graph.same_key_pairs(graph.prepared(fx.supplier_nodes(spark, d)), "irrigation_id")


@query(f"WITH {_NODES} SELECT a.id AS src, b.id AS dst, {rnd(_RAIN)} AS rainfall_similarity FROM n a JOIN n b ON a.id <> b.id AND {_RAIN} > 0.8::DOUBLE")
def graph_rainfall(spark, d):
    n = graph.prepared(fx.supplier_nodes(spark, d))
    return graph.attributes(graph.rainfall_pairs(n), n).select("src", "dst", r6("rainfall_similarity").alias("rainfall_similarity"))


_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query(f"WITH n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.id AS src, b.id AS dst, {rnd(_COS, 5)} AS soil_similarity FROM n a JOIN n b ON a.id <> b.id AND {_COS} > 0.4::DOUBLE")
def graph_cosine(spark, d):
    n = graph.prepared(fx.embedding_nodes(spark, d).withColumn("soil_type", F.lit(None).cast("string")))
    return graph.attributes(graph.cosine_pairs(n, 0.4), n).select("src", "dst", r6("soil_similarity", 5).alias("soil_similarity"))


_ALIKE = "CASE WHEN a.soil = b.soil THEN 1 WHEN a.len < 1e-8::DOUBLE OR b.len < 1e-8::DOUBLE THEN 0 ELSE greatest(0, list_dot_product(a.f, b.f) / (a.len * b.len)) END"
_ALL_EDGES = f"""{_NODES}, e AS (SELECT a.id AS src, b.id AS dst, {_DIST} AS dist, CAST(a.k = b.k AND a.k <> 0 AS DOUBLE) AS shared, {_ALIKE} AS soil, {_RAIN} AS rain FROM n a JOIN n b
  ON a.id <> b.id AND ({_DIST} <= 500 OR (a.k = b.k AND a.k <> 0) OR {_ALIKE} > 0.8::DOUBLE OR {_RAIN} > 0.8::DOUBLE))"""


def _edge_columns(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", r6("distance_m", 4).alias("distance_m"), "shared_irrigation", r6("soil_similarity", 5).alias("soil_similarity"), r6("rainfall_similarity").alias("rainfall_similarity"))


@query(f"WITH {_ALL_EDGES} SELECT src, dst, {rnd('dist', 4)} AS distance_m, shared AS shared_irrigation, {rnd('soil', 5)} AS soil_similarity, {rnd('rain')} AS rainfall_similarity FROM e")
def graph_edges(spark, d):
    return _edge_columns(graph.edges(fx.supplier_nodes(spark, d), threshold=500.0))


@query(f"WITH {_ALL_EDGES} SELECT src, dst, {rnd('dist', 4)} AS distance_m, shared AS shared_irrigation, {rnd('soil', 5)} AS soil_similarity, {rnd('rain')} AS rainfall_similarity FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 3")
def graph_knn(spark, d):
    return _edge_columns(graph.edges(fx.supplier_nodes(spark, d), threshold=500.0, k=3))


@query(f"WITH {_NODES} SELECT a.id AS src, b.id AS dst, {rnd(_ALIKE, 5)} AS soil_similarity FROM n a JOIN n b ON a.id <> b.id AND {_ALIKE} > 0.8::DOUBLE")
def graph_soil(spark, d):
    """Pairs of one soil or of like features."""
    n = graph.prepared(fx.supplier_nodes(spark, d))
    found = graph.same_key_pairs(n, "soil_type").union(graph.cosine_pairs(n)).distinct()
    return graph.attributes(found, n).select("src", "dst", r6("soil_similarity", 5).alias("soil_similarity"))


@query(f"WITH {_ALL_EDGES} SELECT (SELECT count(*) FROM n) AS node_count, count(*) AS edge_count, false AS empty_graph, 'distance_m,shared_irrigation,soil_similarity,rainfall_similarity' AS edge_attributes, 'pytorch_geometric' AS format, CAST(NULL AS INTEGER) AS k_neighbors, 500.0::DOUBLE AS proximity_threshold_m FROM e")
def graph_summary(spark, d):
    nodes = fx.supplier_nodes(spark, d)
    out = graph.summary(nodes, graph.edges(nodes, threshold=500.0), threshold=500.0)
    return out.withColumn("edge_attributes", F.array_join("edge_attributes", ","))


# Patches

_FULL = f"""hw AS (SELECT scene, max("row") + 1 AS h, max(col) + 1 AS w FROM px GROUP BY scene),
  win AS (SELECT scene, r0, c0 FROM (SELECT scene, w, h, unnest(range(0, h - 8 + 1, 4)) AS r0 FROM hw), LATERAL (SELECT unnest(range(0, w - 8 + 1, 4)) AS c0)),
  cells AS (SELECT win.scene, r0, c0, unnest(['nir', 'red']) AS channel, unnest([nir, red]) AS v FROM win JOIN px ON px.scene = win.scene AND px."row" BETWEEN r0 AND r0 + 7 AND px.col BETWEEN c0 AND c0 + 7),
  good AS (SELECT scene, r0, c0 FROM cells GROUP BY ALL HAVING max(v) > min(v)),
  ids AS (SELECT scene, r0, c0, row_number() OVER (ORDER BY scene, r0, c0) - 1 AS patch_id, count(*) OVER () AS n FROM good),
  parts AS (SELECT *, CASE WHEN patch_id < greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train' WHEN patch_id < greatest(greatest(1, floor(n * 0.7::DOUBLE)), floor(n * 0.85::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM ids),
  stats AS (SELECT channel, avg(v) AS mean, stddev_pop(v) AS std FROM cells JOIN parts USING (scene, r0, c0) WHERE split = 'train' GROUP BY channel)"""


def _values(spark, d) -> DataFrame:
    return patches.long_patches(fx.pixels(spark, d), ["red", "nir"], ["scene"], 8, 4)


def _moments(spark, d) -> DataFrame:
    return patches.moments(_values(spark, d), ["scene"])


@query(f"WITH {PX}, {_FULL} SELECT scene, CAST(r0 AS INTEGER) AS row0, CAST(c0 AS INTEGER) AS col0 FROM win")
def patch_grid(spark, d):
    return grid.patch_pixels(fx.pixels(spark, d).select(*place("red")), ["scene"], 8, 4).select("scene", "row0", "col0").distinct()


@query(f"WITH {PX}, {_FULL} SELECT scene, CAST(r0 AS INTEGER) AS row0, CAST(c0 AS INTEGER) AS col0, channel, count(*) AS n, {rnd('avg(v)', 6)} AS mean FROM cells GROUP BY ALL")
def patch_overlap(spark, d):
    return _values(spark, d).groupBy("scene", "row0", "col0", "channel").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("raw"), 6).alias("mean"))


@query(f"WITH {PX}, {_FULL} SELECT scene, CAST(r0 AS INTEGER) AS row0, CAST(c0 AS INTEGER) AS col0, max(v) > min(v) AS valid FROM cells GROUP BY ALL")
def patch_validity(spark, d):
    return patches.validity(_moments(spark, d), ["scene"])


@query(f"WITH {PX}, {_FULL} SELECT patch_id, scene, CAST(r0 AS INTEGER) AS row0, CAST(c0 AS INTEGER) AS col0, split FROM parts")
def patch_split(spark, d):
    return patches.numbered(patches.validity(_moments(spark, d), ["scene"]), ["scene"])


@query(f"""WITH {PX}, {_FULL}, size AS (SELECT greatest(count(*), 7, (SELECT count(*) FROM supplier)) AS n FROM good)
  SELECT CAST(range AS BIGINT) AS index, CASE WHEN range < greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train' WHEN range < greatest(greatest(1, floor(n * 0.7::DOUBLE)), floor(n * 0.85::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM size, LATERAL (SELECT unnest(range(n)) AS range)""")
def exported_splits(spark, d):
    numbered = patches.numbered(patches.validity(_moments(spark, d), ["scene"]), ["scene"])
    return patches.splits(numbered, sequences=7, nodes=fx.load(spark, d, "supplier").count())


@query(f"WITH {PX}, {_FULL} SELECT channel, {rnd('mean', 7)} AS mean, {rnd('std', 7)} AS std FROM stats")
def patch_stats_train(spark, d):
    measured = _moments(spark, d)
    stats = patches.train_statistics(measured, patches.numbered(patches.validity(measured, ["scene"]), ["scene"]), ["scene"])
    return stats.select("channel", r6("mean", 7).alias("mean"), r6("std", 7).alias("std"))


@query(f"WITH {PX}, {_FULL} SELECT patch_id, channel, split, {rnd('sum((v - mean) / std)', 3)} AS total, {rnd('min((v - mean) / std)', 5)} AS low, {rnd('max((v - mean) / std)', 5)} AS high FROM cells JOIN parts USING (scene, r0, c0) JOIN stats USING (channel) GROUP BY ALL")
def patch_normalized(spark, d):
    measured = _moments(spark, d)
    numbered = patches.numbered(patches.validity(measured, ["scene"]), ["scene"])
    out = patches.normalized(_values(spark, d), numbered, patches.train_statistics(measured, numbered, ["scene"]), ["scene"])
    return out.groupBy("patch_id", "channel", "split").agg(r6(F.sum("normalized"), 3).alias("total"), r6(F.min("normalized"), 5).alias("low"), r6(F.max("normalized"), 5).alias("high"))


# Validation


def _repeated(spark, d) -> DataFrame:
    """Headers in which some scenes come twice."""
    every = fx.scenes(spark, d)
    return every.unionByName(every.where("input_ord % 5 = 0").withColumn("input_ord", F.col("input_ord") + 1_000_000))


@query(f"WITH {SCENES} SELECT scene_id AS subject, concat('Duplicate scene: ', scene_id) AS message FROM scenes WHERE input_ord % 5 = 0")
def dup_ids(spark, d):
    return validate.duplicates(_repeated(spark, d)).select("subject", "message")


@query(f"""WITH {RX}, {SCENES} SELECT 'error' AS severity, 'missing_crs' AS rule, scene_id AS subject, concat('Missing CRS for ', scene_id) AS message FROM scenes WHERE crs = ''
  UNION ALL SELECT 'warning', 'high_cloud', CAST(scene AS VARCHAR), concat('High cloud cover for ', scene, ': ', printf('%.2f', avg(CAST(cloud AS INTEGER)))) FROM rx GROUP BY scene HAVING avg(CAST(cloud AS INTEGER)) > 0.4::DOUBLE
  UNION ALL SELECT 'warning', 'missing_modality', 'weather', 'Missing modality: weather'""")
def validation_report(spark, d):
    headers = fx.scenes(spark, d)
    fractions = preprocess.cloud_fraction(optical(spark, d), ["scene"]).withColumnRenamed("scene", "scene_id")
    return validate.report(validate.duplicates(headers), validate.missing_crs(headers), validate.clouds(fractions), validate.missing_modalities(headers, ("optical", "sar", "weather")))


@query("SELECT CAST(k AS VARCHAR) AS subject, concat('Graph edge references invalid node index: ', k) AS message FROM (SELECT DISTINCT unnest([l_orderkey, l_suppkey]) AS k FROM lineitem) WHERE k NOT IN (SELECT s_suppkey FROM supplier)")
def edge_integrity(spark, d):
    named = fx.load(spark, d, "lineitem").selectExpr("l_orderkey AS src", "l_suppkey AS dst")
    return validate.edge_integrity(named, fx.load(spark, d, "supplier").selectExpr("s_suppkey AS node_id")).select("subject", "message")


@query("""WITH c AS (SELECT DISTINCT event_id // 400 AS s FROM events), k AS (SELECT count(*) AS n, count(*) FILTER (s % 7 = 3) AS few, count(*) FILTER (s % 5 = 0) AS bare FROM c)
  SELECT 'error' AS severity, 'missing_bands' AS rule, CAST(s AS VARCHAR) AS subject, concat('Missing bands for ', s) AS message FROM c WHERE s % 5 = 0 UNION ALL
  SELECT 'error', 'empty_cube', CAST(s AS VARCHAR), concat('Feature cube has no features: ', s) FROM c WHERE s % 6 = 0 UNION ALL
  SELECT 'error', 'unlike_features', CAST(s AS VARCHAR), concat('Feature cube ', s, ' lacks [ndvi] and adds [vv]') FROM c WHERE s % 7 = 3 UNION ALL
  SELECT 'warning', 'empty_graph', 'graph', 'Vision-only pipeline: graph validation skipped.'""")
def cube_rules(spark, d):
    s = fx.scenes(spark, d).withColumn("s", F.col("input_ord"))
    bands = s.select("scene_id", F.when(F.col("s") % 5 > 0, 3).alias("n_bands"))
    cubes = s.select(F.col("scene_id").alias("observation_id"), "input_ord", F.when(F.col("s") % 6 == 0, 0).otherwise(4).alias("n_features"), F.when(F.col("s") % 7 == 3, F.array(F.lit("vv"), F.lit("evi"))).otherwise(F.array(F.lit("ndvi"), F.lit("evi"))).alias("features"))
    return validate.report(validate.missing_bands(bands), validate.empty_cubes(cubes), validate.unlike_features(cubes), validate.empty_graph(fx.supplier_nodes(spark, d).limit(0)))


@query("""WITH t AS (SELECT event_id // 20 AS q, event_id % 20 AS step, event_id // 20 * 100 + CASE WHEN event_id // 20 % 3 = 1 AND event_id % 20 = 7 THEN 0 WHEN event_id // 20 % 4 = 2 AND event_id % 20 = 9 THEN 8 ELSE event_id % 20 END AS ts FROM events)
  SELECT 'error' AS severity, 'not_chronological' AS rule, CAST(q AS VARCHAR) AS subject, concat('Sequence ', q, ' timestamps are not chronological') AS message FROM (SELECT q, ts < lag(ts) OVER (PARTITION BY q ORDER BY step) AS late FROM t) GROUP BY q HAVING bool_or(late)
  UNION ALL SELECT 'warning', 'duplicate_timestamps', CAST(q AS VARCHAR), concat('Sequence ', q, ' contains duplicate timestamps') FROM t GROUP BY q HAVING count(ts) > count(DISTINCT ts)""")
def sequence_rules(spark, d):
    steps = fx.load(spark, d, "events").selectExpr("event_id div 20 AS sequence_id", "event_id % 20 AS step").selectExpr("sequence_id", "step", "sequence_id * 100 + CASE WHEN sequence_id % 3 = 1 AND step = 7 THEN 0 WHEN sequence_id % 4 = 2 AND step = 9 THEN 8 ELSE step END AS ts")
    return validate.sequences(steps)


@query(f"WITH {PX} SELECT 'pixels' AS what, count(*) AS n FROM px UNION ALL SELECT 'scenes', count(DISTINCT scene) FROM px UNION ALL SELECT 'nodes', count(*) FROM supplier")
def table_counts(spark, d):
    return validate.counts(pixels=fx.pixels(spark, d), scenes=fx.scenes(spark, d), nodes=fx.supplier_nodes(spark, d))


@query(f"""WITH {PX}, {_FULL}, c AS (SELECT count(*) AS n FROM good) SELECT n AS patches, {rnd("(SELECT mean FROM stats WHERE channel = 'nir')", 6)} AS nir_mean, CAST(greatest(1, floor(n * 0.7::DOUBLE)) - 1 AS BIGINT) AS last_train, 8::BIGINT AS steps, (SELECT count(*) FROM supplier) AS nodes, false AS empty_graph FROM c""")
def dataset_manifest(spark, d):
    """What the description of a dataset says, and its sequence and graph are whole in its file."""
    measured = _moments(spark, d)
    numbered = patches.numbered(patches.validity(measured, ["scene"]), ["scene"])
    nodes = fx.supplier_nodes(spark, d)
    sequence = temporal.sequence(_scene_means(spark, d), ["ndvi", "evi"])
    edges = graph.edges(nodes, threshold=500.0, k=2).persist(StorageLevel.DISK_ONLY)  # counted, then written
    try:
        body = export.manifest(patches=numbered, statistics=patches.train_statistics(measured, numbered, ["scene"]), splits=patches.splits(numbered), sequence=sequence, nodes=nodes, edges=edges)
        graph_ = body["graph"]
        with tempfile.TemporaryDirectory(prefix="fieldweave-") as folder:
            written = export.write_whole(f"{folder}/dataset.json", body, nodes, edges)
    finally:
        edges.unpersist()
    if written != (graph_["node_count"], graph_["edge_count"]) or len(body["temporal"]["sequences"]) != 8:
        raise ValueError("the description is not whole")
    row = (body["patches"], round(body["statistics"]["nir"]["mean"], 6), body["splits"]["train"][1], len(body["temporal"]["masks"]), graph_["node_count"], graph_["empty_graph"])
    return spark.createDataFrame([row], "patches long, nir_mean double, last_train long, steps long, nodes long, empty_graph boolean")


# Sources

_SETTINGS = """
request:
  aoi_name: "demo: field"   # quoted
  start_date: 2026-01-01
  end_date: 2026-01-31
  modalities: [optical, 'sar']
logging:
  level: DEBUG
validation:
  required_modalities:
    - optical
    - tide
providers:
  - name: modis
  - name: open
    kind: stac
    enabled: false
    collections: [a, b]
    max_items: 5
"""


@query("""SELECT * FROM (VALUES ('request', 'demo: field 2026-01-01 2026-01-31 optical,sar'), ('log', 'work/logs/discovery.log DEBUG'), ('report', 'work/discovery/discovery_report.json'), ('required', 'optical,tide'),
  ('modis', 'true static 100 '), ('open', 'false stac 5 a,b')) t(setting, value)""")
def settings_file(spark, d):
    found = config.loads(_SETTINGS)
    r = found.request
    rows = [("request", f"{r.aoi_name} {r.start_date} {r.end_date} {','.join(r.modalities)}"), ("log", f"{found.log_file} {found.log_level}"), ("report", found.output_metadata_path), ("required", ",".join(found.required_modalities))]
    rows += [(p.name, f"{str(p.enabled).lower()} {p.kind} {p.max_items} {','.join(p.collections)}") for p in found.providers]
    return spark.createDataFrame(rows, "setting string, value string")


_ITEMS = """i AS (SELECT page_id, concat('p', page_id % 200) AS product_id, ['sentinel-2-l2a', 'sentinel-1-grd', 'weather-daily', 'soil-map', 'landsat-l1c'][page_id % 5 + 1] AS collection, url FROM pages),
  k AS (SELECT *, CASE page_id % 5 WHEN 1 THEN 'sar' WHEN 2 THEN 'weather' WHEN 3 THEN 'ancillary' ELSE 'optical' END AS modality FROM i)"""


@query(f"""WITH {_ITEMS} SELECT page_id, product_id, collection, modality, concat('2024-02-', lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0')) AS acquisition_date, CAST(page_id % 60 AS DOUBLE) AS spatial_resolution_m,
  CASE WHEN page_id % 3 <> 0 THEN concat('EPSG:', 32600 + page_id % 60) END AS crs, 'B04,visual' AS bands, CAST(page_id % 101 AS DOUBLE) AS cloud_cover_percent, CASE page_id % 5 WHEN 0 THEN 'surface_reflectance' WHEN 4 THEN 'top_of_atmosphere' END AS product_level, url AS access_url FROM k""")
def stac_candidates(spark, d):
    found = catalog.candidates(fx.items(spark, d), "demo", keep=("page_id",))
    bands = F.array_join("bands", ",").alias("bands")
    return found.select("page_id", "product_id", "collection", "modality", "acquisition_date", "spatial_resolution_m", "crs", bands, "cloud_cover_percent", "product_level", "access_url")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('VV', page_id % 3, ',VH') ELSE 'a,z' END AS bands, CASE WHEN page_id % 3 = 0 THEN 'L1' WHEN page_id % 2 = 0 THEN 'surface_reflectance' END AS product_level FROM pages""")
def item_bands(spark, d):
    """Bands named by an item's properties come before its assets, and its own level before one told by the collection."""
    item = """to_json(named_struct('id', 'x', 'collection', CASE WHEN page_id % 2 = 0 THEN 'surface-x' ELSE 'other' END, 'properties', map_filter(map('eo:bands', CASE WHEN page_id % 2 = 0 THEN concat('[{"name":"VV', page_id % 3, '"},{"name":""},{"name":"VH"}]') END,
      'processing:level', CASE WHEN page_id % 3 = 0 THEN 'L1' END), (k, v) -> v IS NOT NULL), 'assets', map('z', named_struct('href', url), 'a', named_struct('href', url)))) AS item"""
    found = catalog.candidates(fx.load(spark, d, "pages").selectExpr("page_id", item), "demo", keep=("page_id",))
    return found.select("page_id", F.array_join("bands", ",").alias("bands"), "product_level")


@query("""SELECT concat('p', page_id) AS product_id, concat_ws(',', CASE WHEN page_id % 2 = 0 THEN 'source' END, CASE WHEN page_id % 3 = 0 THEN 'collection' END) AS missing FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0""")
def candidate_fields(spark, d):
    found = fx.load(spark, d, "pages").selectExpr("'demo' AS provider", "CASE WHEN page_id % 2 > 0 THEN 's' END AS source", "CASE WHEN page_id % 3 > 0 THEN 'c' ELSE '' END AS collection", "concat('p', page_id) AS product_id", "'sar' AS modality")
    return catalog.missing_fields(found).select("product_id", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {_ITEMS}, n AS (SELECT product_id, count(*) AS n FROM k GROUP BY 1) SELECT concat('duplicate ', product_id, ' ', CAST(unnest(range(2, n + 1)) AS VARCHAR)) AS warning FROM n WHERE n > 1 UNION ALL SELECT 'missing tide'""")
def candidate_validation(spark, d):
    found = catalog.candidates(fx.items(spark, d), "demo")
    twice = catalog.duplicate_products(found).select(F.concat_ws(" ", F.lit("duplicate"), "product_id", F.col("occurrence").cast("string")).alias("warning"))
    asked = spark.createDataFrame([("optical",), ("sar",), ("tide",)], "modality string")
    return twice.unionByName(asked.join(found.select("modality").distinct(), "modality", "left_anti").select(F.concat(F.lit("missing "), "modality").alias("warning")))


@query("SELECT doc_id, replace(replace(concat(source, '/', lang, ':', doc_id), '/', '_'), ':', '_') AS name, sha256(text) AS checksum_sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def sha256_manifest(spark, d):
    docs = fx.load(spark, d, "documents").withColumn("name", artifacts.safe_name(F.concat("source", F.lit("/"), "lang", F.lit(":"), F.col("doc_id").cast("string"))))
    return artifacts.checksums(docs, "text").select("doc_id", "name", "checksum_sha256", "bytes")
