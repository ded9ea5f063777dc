"""Discovery of datasets: catalog responses and built-in templates as rows of candidates.

Responses are JSON text. They are parsed and mapped by column expressions, so
a table of responses of any size is one query; fetching them is left to a
transport, which tests replace.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CandidateError, ProviderError
from .config import ProviderSettings, Request, Settings

CANDIDATE = (
    "provider string, source string, collection string, product_id string, modality string, acquisition_date string, start_date string, end_date string, "
    "spatial_resolution_m double, crs string, bands array<string>, cloud_cover_percent double, product_level string, preprocessing_state string, access_url string, metadata map<string,string>"
)
REQUIRED = ("provider", "source", "collection", "product_id", "modality")
TIMEOUT = 30

#: Built-in catalog entries: source, collection, modality, bands, resolution in metres, reference system. Fixed values.
TEMPLATES = {
    "resourcesat": ("Bhuvan/Bhoonidhi", "Resourcesat LISS/AWiFS", "optical", ["green", "red", "nir", "swir"], 23.5, None),
    "awifs": ("Bhuvan/Bhoonidhi", "AWiFS", "optical", ["green", "red", "nir", "swir"], 56.0, None),
    "eos-04": ("Bhoonidhi", "EOS-04 SAR", "sar", ["HH", "HV", "VV", "VH"], None, None),
    "modis": ("NASA/LP DAAC", "MODIS surface reflectance and vegetation products", "optical", ["red", "nir", "blue", "swir", "ndvi", "evi"], 250.0, "Sinusoidal"),
    "weather": ("Weather data catalog", "Rainfall/Temperature/Humidity/Solar Radiation/ET0", "weather", ["rainfall", "temperature", "humidity", "solar_radiation", "et0"], None, None),
    "ancillary-gis": ("Ancillary GIS catalog", "Administrative boundaries/soil/irrigation layers", "ancillary", [], None, None),
}

#: Fixed texts of the report's warnings and fallbacks.
TEXTS = {
    "credential": "{name} skipped because credential {env} is not set",
    "portal": "Use portal/API credentials for {name} or configure an open STAC endpoint.",
    "failed": "{name} failed: {error}",
    "review": "Review {name} configuration or use an alternate source.",
    "no_items": "{name} returned no items for requested AOI/date range",
    "disabled": "Provider {name} disabled by configuration",
    "duplicate": "Duplicate product_id discovered: {name}",
    "no_modality": "No candidate discovered for required modality: {name}",
    "nothing": "No dataset candidates discovered; configure credentials, AOI geometry, or fallback providers",
}

ITEM = """struct<id:string, collection:string, stac_version:string, properties:map<string,string>, assets:map<string,string>>"""


def post_json(url: str, payload: dict, timeout: float = TIMEOUT) -> dict:
    """The default transport."""
    request = urllib.request.Request(url, data=json.dumps(payload).encode(), headers={"Content-Type": "application/json"}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.loads(response.read())
    except urllib.error.URLError as error:
        raise ProviderError(f"{url}: {error}") from error


def _given(c: Column) -> Column:
    return F.when((c != "") & (c != "null"), c)


def first_number(*values: Column) -> Column:
    return F.coalesce(*[v.try_cast("double") for v in values])


def infer_modality(collection: Column, configured: tuple[str, ...] = ()) -> Column:
    if configured:
        return F.lit(configured[0])
    low = F.lower(collection)
    return F.when(low.contains("sentinel-1") | low.contains("sar"), "sar").when(low.contains("weather"), "weather").when(low.contains("boundary") | low.contains("soil"), "ancillary").otherwise("optical")


def infer_level(collection: Column, properties: Column) -> Column:
    low = F.lower(collection)
    named = F.coalesce(*[_given(properties[k]) for k in ("processing:level", "sentinel:processing_baseline", "landsat:correction")])
    return F.coalesce(named, F.when(low.contains("l2a") | low.contains("surface"), "surface_reflectance").when(low.contains("l1c"), "top_of_atmosphere"))


def infer_bands(properties: Column, assets: Column) -> Column:
    """Names of ``eo:bands`` if there are any, else the names of the assets in order."""
    names = F.filter(F.transform(F.from_json(properties["eo:bands"], "array<struct<name:string>>"), lambda b: b["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, names).otherwise(F.array_sort(F.coalesce(F.map_keys(assets), F.array().cast("array<string>"))))


def infer_crs(properties: Column) -> Column:
    return F.coalesce(F.concat(F.lit("EPSG:"), properties["proj:epsg"]), _given(properties["proj:wkt2"]), properties["crs"])


def first_href(assets: Column) -> Column:
    hrefs = F.transform(F.map_values(assets), lambda a: F.get_json_object(a, "$.href"))
    return F.get(F.filter(hrefs, lambda h: F.coalesce(h, F.lit("")) != ""), F.lit(0))


def candidates(items: DataFrame, provider: str, modalities: tuple[str, ...] = (), item: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidates from rows with one item's JSON each, and the columns ``keep``. A size that is no number gives way to the code of the reference system."""
    parsed = items.select(*keep, F.from_json(F.col(item), ITEM).alias("i"))
    p, a = F.col("i.properties"), F.col("i.assets")
    collection = F.coalesce(_given(F.col("i.collection")), _given(p["collection"]), F.lit("unknown"))
    day = lambda c: F.left(_given(c), F.lit(10))
    return parsed.select(
        *keep,
        F.lit(provider).alias("provider"),
        F.lit(provider).alias("source"),
        collection.alias("collection"),
        F.coalesce(_given(F.col("i.id")), _given(p["product_id"]), F.lit("unknown")).alias("product_id"),
        infer_modality(collection, modalities).alias("modality"),
        day(p["datetime"]).alias("acquisition_date"),
        day(p["start_datetime"]).alias("start_date"),
        day(p["end_datetime"]).alias("end_date"),
        F.when(p["gsd"].isNotNull(), first_number(p["gsd"], p["proj:epsg"])).alias("spatial_resolution_m"),
        infer_crs(p).alias("crs"),
        infer_bands(p, a).alias("bands"),
        first_number(p["eo:cloud_cover"], p["cloud_cover"], p["landsat:cloud_cover_land"]).alias("cloud_cover_percent"),
        infer_level(collection, p).alias("product_level"),
        F.lit("raw").alias("preprocessing_state"),
        first_href(a).alias("access_url"),
        F.create_map(F.lit("stac_version"), F.col("i.stac_version"), F.lit("platform"), p["platform"], F.lit("instrument"), p["instruments"]).alias("metadata"),
    )


def has_credential(settings: ProviderSettings) -> bool:
    return bool(settings.credential_env and os.environ.get(settings.credential_env))


def search(spark: SparkSession, settings: ProviderSettings, request: Request, transport: Callable[[str, dict], dict] = post_json) -> tuple[DataFrame, list[str]]:
    """Candidates of a catalog's answer to one search, first page only, and warnings."""
    payload = {"collections": list(settings.collections), "datetime": f"{request.start_date}/{request.end_date}", "limit": settings.max_items}
    if request.aoi_geojson:
        payload["intersects"] = request.aoi_geojson
    found = transport(settings.endpoint, payload).get("features", [])
    if not isinstance(found, list):
        raise ProviderError(f"{settings.name}: the answer's features are no list")
    items = spark.createDataFrame([(json.dumps(f),) for f in found], "item string")
    return candidates(items, settings.name, settings.modalities), [] if found else [TEXTS["no_items"].format(name=settings.name)]


def template(spark: SparkSession, settings: ProviderSettings, request: Request) -> DataFrame:
    """The built-in entry of a provider as one candidate."""
    if settings.name.lower() not in TEMPLATES:
        raise ProviderError(f"no built-in catalog entry for {settings.name}")
    source, collection, modality, bands, resolution, crs = TEMPLATES[settings.name.lower()]
    start, end = request.start_date.isoformat(), request.end_date.isoformat()
    notes = {"aoi_name": request.aoi_name, "season": request.season, "note": "catalog entry only; scenes need the provider's own search"}
    row = (settings.name, source, collection, f"{settings.name}:{request.aoi_name}:{start}:{end}", modality, None, start, end, resolution, crs, bands, None, "catalog_reference", "raw", None, notes)
    return spark.createDataFrame([row], CANDIDATE)


def discover_one(spark: SparkSession, settings: ProviderSettings, request: Request, transport: Callable[[str, dict], dict] = post_json) -> tuple[DataFrame | None, list[str], list[str]]:
    """Candidates, warnings and fallbacks of one provider."""
    if settings.kind not in ("stac", "static"):
        raise ProviderError(f"unknown kind of provider {settings.name}: {settings.kind}")
    if settings.kind == "stac" and not settings.endpoint:
        raise ProviderError(f"provider {settings.name} needs an endpoint")
    if settings.requires_credentials and not has_credential(settings):
        hint = [TEXTS["portal"].format(name=settings.name)] if settings.kind == "static" else []
        return None, [TEXTS["credential"].format(name=settings.name, env=settings.credential_env)], hint
    try:
        if settings.kind == "stac":
            found, warnings = search(spark, settings, request, transport)
            return found, warnings, []
        return template(spark, settings, request), [], []
    except ProviderError as error:
        return None, [TEXTS["failed"].format(name=settings.name, error=error)], [TEXTS["review"].format(name=settings.name)]


def missing_fields(found: DataFrame) -> DataFrame:
    """Candidates without a required field, with the names of those fields."""
    lacking = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED]), lambda c: c.isNotNull())
    return found.select("provider", "product_id", lacking.alias("missing")).where(F.size("missing") > 0)


def duplicate_products(found: DataFrame) -> DataFrame:
    """One row for each repetition of a product."""
    again = found.groupBy("product_id").count().where("count > 1")
    return again.select("product_id", F.explode(F.sequence(F.lit(2).cast("long"), F.col("count"))).alias("occurrence"))


def candidate_warnings(found: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Warnings on candidates; one that lacks a required field is an error."""
    wrong = missing_fields(found).limit(1).collect()
    if wrong:
        raise CandidateError(f"candidate {wrong[0]['product_id']} of {wrong[0]['provider']} lacks {wrong[0]['missing']}")
    out = [TEXTS["duplicate"].format(name=r["product_id"]) for r in duplicate_products(found).orderBy("product_id").toLocalIterator()]
    present = {r[0] for r in found.select("modality").distinct().collect()}
    out += [TEXTS["no_modality"].format(name=m) for m in required if m not in present]
    if not present:
        out.append(TEXTS["nothing"])
    return out


def write_report(path: Path, report: dict, found: DataFrame) -> None:
    """The report with all candidates, which are written one after the other."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8") as out:
        out.write(json.dumps(report, indent=2).removesuffix("\n}") + ',\n  "candidates": [')
        for i, r in enumerate(found.select(F.to_json(F.struct("*"))).toLocalIterator()):
            out.write((",\n    " if i else "\n    ") + json.dumps(json.loads(r[0])))
        out.write("\n  ]\n}")


def discover(spark: SparkSession, settings: Settings, transport: Callable[[str, dict], dict] = post_json, write: bool = True) -> tuple[DataFrame, dict]:
    """Ask all enabled providers; candidates, and the report, which is also written."""
    all_found, warnings, fallbacks = spark.createDataFrame([], CANDIDATE), [], []
    for one in settings.providers:
        if not one.enabled:
            warnings.append(TEXTS["disabled"].format(name=one.name))
            continue
        found, some, more = discover_one(spark, one, settings.request, transport)
        warnings, fallbacks = warnings + some, fallbacks + more
        if found is not None:
            all_found = all_found.unionByName(found)
    warnings += candidate_warnings(all_found, settings.required_modalities)
    report = {
        "generated_at": dt.datetime.now(dt.UTC).isoformat(),
        "aoi_name": settings.request.aoi_name,
        "start_date": settings.request.start_date.isoformat(),
        "end_date": settings.request.end_date.isoformat(),
        "defaults_used": settings.defaults,
        "warnings": list(dict.fromkeys(warnings)),
        "fallbacks": list(dict.fromkeys(fallbacks)),
    }
    if write:
        write_report(Path(settings.output_metadata_path), report, all_found)
    return all_found, report
