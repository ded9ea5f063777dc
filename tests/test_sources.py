import dataclasses
import datetime as dt
import hashlib
import json

import numpy as np
import pytest

from fieldweave.errors import CandidateError, ConfigurationError, DownloadError, ProviderError
from fieldweave.sources import artifacts, catalog, config, export, scenes
from fieldweave.streaming.ingest import ingest

TEXT = """
request:   # what to look for
  aoi_name: "demo area"
  start_date: 2026-01-01
  end_date: 2026-01-31
  modalities: [optical, sar]
defaults:
  resolution: 10
  factor: 0.5
validation:
  required_modalities:
    - optical
    - tide
providers:
  - name: modis
    kind: static
  - name: open
    kind: stac
    endpoint: http://catalog
    collections: [sentinel-2-l2a]
    max_items: 5
  - name: closed
    requires_credentials: true
    credential_env: NO_SUCH_VARIABLE
  - name: off
    enabled: false
"""


@pytest.fixture
def settings(tmp_path):
    path = tmp_path / "discovery.yaml"
    path.write_text(TEXT + f"output_metadata_path: {tmp_path}/report.json\n")
    return config.load(path)


def test_settings(settings):
    assert settings.request == config.Request("demo area", dt.date(2026, 1, 1), dt.date(2026, 1, 31), modalities=("optical", "sar"))
    assert [p.name for p in settings.providers] == ["modis", "open", "closed", "off"] and settings.providers[1].max_items == 5
    assert settings.defaults == {"resolution": 10, "factor": "0.5"} and settings.required_modalities == ("optical", "tide")


REQUEST = "request:\n  aoi_name: a\n  start_date: 2026-01-01\n  end_date: 2026-01-31\n"


@pytest.mark.parametrize("text", ["request:\n  aoi_name: a\n", "just text", "providers:\n  - name: x\n", REQUEST, REQUEST + "providers: 5\n", REQUEST + "providers:\n  - kind: stac\n", REQUEST + "providers:\n  - name: x\n    max_items: many\n", REQUEST.replace("2026-01-31", "soon") + "providers:\n  - name: x\n", REQUEST.replace("01-31", "13-31") + "providers: []\n"])
def test_wrong_settings(tmp_path, text):
    path = tmp_path / "x.yaml"
    path.write_text(text)
    with pytest.raises(ConfigurationError):
        config.load(path)


def test_requests_are_checked():
    with pytest.raises(ConfigurationError):
        config.Request("a", dt.date(2026, 2, 1), dt.date(2026, 1, 1))
    with pytest.raises(ConfigurationError):
        config.Request("", dt.date(2026, 1, 1), dt.date(2026, 1, 1))


ITEM = {"id": "p/1:2", "collection": "Sentinel-1-GRD", "stac_version": "1.0", "properties": {"datetime": "2026-01-05T10:00:00Z", "gsd": "high", "proj:epsg": 32643, "eo:bands": [{"name": "VV"}, {"name": ""}, {"name": "VH"}], "cloud_cover": 3.5, "processing:level": "L1"}, "assets": {"z": {"title": "none"}, "a": {"href": "http://f"}}}


def test_discovery(spark, settings):
    asked = []

    def transport(url, payload):
        asked.append((url, payload))
        return {"features": [ITEM, ITEM]}

    found, report = catalog.discover(spark, settings, transport)
    rows = found.collect()
    assert asked[0][1]["datetime"] == "2026-01-01/2026-01-31" and asked[0][1]["limit"] == 5
    item = next(r for r in rows if r["provider"] == "open")
    assert (item["modality"], item["acquisition_date"], item["spatial_resolution_m"], item["crs"], item["bands"]) == ("sar", "2026-01-05", 32643.0, "EPSG:32643", ["VV", "VH"])
    assert (item["cloud_cover_percent"], item["product_level"], item["access_url"]) == (3.5, "L1", "http://f")
    assert "Duplicate product_id discovered: p/1:2" in report["warnings"] and "No candidate discovered for required modality: tide" in report["warnings"]
    assert any("closed skipped" in w for w in report["warnings"]) and any("off disabled" in w for w in report["warnings"])
    written = json.loads(open(settings.output_metadata_path).read())
    assert len(written["candidates"]) == 3


def test_reports_are_whole(spark, settings, monkeypatch):
    many = spark.range(101_000).selectExpr("'open' provider", "'s' source", "'c' collection", "concat('p', id % 99900) product_id", "'sar' modality")
    monkeypatch.setattr(catalog, "discover_one", lambda spark, one, request, transport: (many, [], []))
    monkeypatch.setattr(catalog, "CANDIDATE", "provider string, source string, collection string, product_id string, modality string")
    _, report = catalog.discover(spark, dataclasses.replace(settings, providers=tuple(x for x in settings.providers if x.enabled)[:1]))
    assert sum(w.startswith("Duplicate") for w in report["warnings"]) == 1100
    assert len(json.loads(open(settings.output_metadata_path).read())["candidates"]) == 101_000


def test_failing_providers(spark, settings):
    found, report = catalog.discover(spark, settings, lambda url, payload: {"features": 7}, write=False)
    assert any("open failed" in w for w in report["warnings"]) and found.count() == 1
    with pytest.raises(ProviderError):
        catalog.discover_one(spark, config.ProviderSettings("x", kind="ftp"), settings.request)
    wrong = found.withColumn("source", found["access_url"])
    with pytest.raises(CandidateError):
        catalog.candidate_warnings(wrong, ())


def test_downloads(tmp_path):
    calls = []

    def fetcher(url, path, start):
        calls.append((url, start))
        path.write_bytes(b"good" if len(calls) > 1 else b"bad")

    good = hashlib.sha256(b"good").hexdigest()
    rows = [{"product_id": "a/b:c", "modality": "sar", "access_url": "u", "checksum_sha256": good}, {"product_id": "m", "modality": "sar"}]
    out = artifacts.download_all(rows, tmp_path, tmp_path / "manifest.json", fetcher=fetcher, wait=0)
    assert out[0]["local_path"].endswith("sar/a_b_c.dat") and out[0]["metadata"] == {"attempts": 2} and out[1]["metadata"] == {"status": "metadata_only"}
    assert len(artifacts.read_json(tmp_path / "manifest.json")["artifacts"]) == 2
    with pytest.raises(DownloadError):
        artifacts.download_all([{"product_id": "x", "modality": "sar", "access_url": "u", "checksum_sha256": "no"}, *rows], tmp_path, tmp_path / "second.json", fetcher=fetcher, wait=0)
    kept = artifacts.read_json(tmp_path / "second.json")["artifacts"]
    assert [a["metadata"].get("status") for a in kept] == ["failed", None, "metadata_only"] and kept[1]["resumed"]
    with pytest.raises(DownloadError):
        artifacts.download({"product_id": "x", "modality": "sar", "access_url": "u", "checksum_sha256": "no"}, tmp_path, fetcher=fetcher, wait=0)


def test_fetching_goes_on_or_starts_anew(tmp_path):
    import http.server
    import threading

    body, seen = b"0123456789" * 100, []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = self.headers.get("Range")
            seen.append(asked)
            start = int(asked[6:-1]) if asked and self.path == "/ranges" else 0
            self.send_response(206 if start else 200)
            self.end_headers()
            self.wfile.write(body[start:])

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    for path in ("ranges", "whole"):
        (tmp_path / "sar").mkdir(exist_ok=True)
        (tmp_path / f"sar/{path}.part").write_bytes(body[:30])
        out = artifacts.download({"product_id": path, "modality": "sar", "access_url": f"http://127.0.0.1:{server.server_port}/{path}", "checksum_sha256": hashlib.sha256(body).hexdigest()}, tmp_path, wait=0)
        assert out["resumed"] and out["metadata"] == {"attempts": 1} and (tmp_path / f"sar/{path}.dat").read_bytes() == body
    assert seen == ["bytes=30-"] * 2
    from fieldweave.errors import ProviderError as Fails

    with pytest.raises(Fails):
        catalog.post_json("http://127.0.0.1:9/none", {}, timeout=1)
    server.shutdown()


def test_json_is_safe(tmp_path):
    artifacts.write_json(tmp_path / "x.json", {"a": float("nan"), "b": np.arange(2), "c": dt.date(2026, 1, 1), "d": (np.float32(0.5), {1: None})})
    assert artifacts.read_json(tmp_path / "x.json") == {"a": None, "b": [0, 1], "c": "2026-01-01", "d": [0.5, {"1": None}]}


def test_manifest_holds_sequence_and_graph(spark, tmp_path):
    patches = spark.range(10).selectExpr("id AS patch_id", "'train' AS split")
    statistics = spark.createDataFrame([("a", 1.0, 2.0)], "channel string, mean double, std double")
    splits = spark.createDataFrame([("train", 0), ("train", 6), ("val", 7), ("test", 8), ("test", 9)], "split string, index long")
    sequence = spark.createDataFrame([(1, "2026-01-11", 0, [2.0]), (0, "2026-01-01", 1, [1.0])], "step int, ts string, mask long, features array<double>")
    nodes = spark.createDataFrame([(0, 1.0), (1, 2.0)], "node_id long, x double")
    edges = spark.createDataFrame([(1, 0, 1.0, 0.0, float("nan"), 1.0), (0, 1, 1.0, 0.0, 0.5, 1.0)], "src long, dst long, distance_m double, shared_irrigation double, soil_similarity double, rainfall_similarity double")
    tables = {"patches": patches, "statistics": statistics, "splits": splits, "sequence": sequence, "nodes": nodes, "edges": edges}
    body = export.write_manifest(str(tmp_path / "dataset.json"), metadata={"k": 1}, **tables)
    assert body == artifacts.read_json(tmp_path / "dataset.json") and body["splits"]["test"] == [8, 9]
    assert body["temporal"] == {"timestamps": ["2026-01-01", "2026-01-11"], "masks": [1, 0], "sequences": [[1.0], [2.0]]}
    assert body["graph"]["edge_index"] == [[0, 1], [1, 0]] and body["graph"]["edge_attr"][1] == [1.0, 0.0, None, 1.0]
    assert spark.read.parquet(body["tables"]["edges"]).count() == 2
    assert "nodes" not in export.manifest(most=3, **tables)["graph"] and export.manifest(**tables | {"nodes": nodes.limit(0), "edges": edges.limit(0)})["graph"]["empty_graph"]


def test_a_large_graph_is_whole_in_the_file(spark, tmp_path):
    one = {"patches": spark.range(1).selectExpr("id AS patch_id", "'train' AS split"), "statistics": spark.createDataFrame([("a", 1.0, 2.0)], "channel string, mean double, std double")}
    one |= {"splits": spark.createDataFrame([("train", 0)], "split string, index long"), "sequence": spark.createDataFrame([(0, "2026-01-01", 1, [1.0])], "step int, ts string, mask long, features array<double>")}
    nodes = spark.range(50).selectExpr("id AS node_id", "CASE WHEN id = 3 THEN double('NaN') ELSE id / 2 END AS x", "array(id * 1D) AS features")
    edges = spark.range(90).selectExpr("id % 50 AS src", "id * 7 % 50 + id div 50 AS dst", "id * 1D AS distance_m", "0D AS shared_irrigation", "0.5D AS soil_similarity", "1D AS rainfall_similarity")
    small = export.write_manifest(str(tmp_path / "a" / "dataset.json"), metadata={}, **one, nodes=nodes, edges=edges)
    export.write_manifest(str(tmp_path / "b" / "dataset.json"), metadata={}, most=5, **one, nodes=nodes, edges=edges)
    large = artifacts.read_json(tmp_path / "b" / "dataset.json")
    assert len(small["graph"]["nodes"]) == 50 and len(small["graph"]["edge_attr"]) == 90
    assert large["graph"] == small["graph"] and large["temporal"] == small["temporal"]
    assert export.write_whole(tmp_path / "c.json", large, nodes.limit(0), edges.limit(0)) == (0, 0) and artifacts.read_json(tmp_path / "c.json")["graph"]["edge_index"] == [[], []]


def test_checksums(spark, tmp_path):
    (tmp_path / "f.dat").write_bytes(b"x")
    row = artifacts.file_checksums(spark, str(tmp_path)).first()
    assert row["checksum_sha256"] == hashlib.sha256(b"x").hexdigest() and row["bytes"] == 1
    found = spark.createDataFrame([("p", "1"), ("q", "2")], "product_id string, checksum_sha256 string")
    want = spark.createDataFrame([("p", "9"), ("q", "")], "product_id string, checksum_sha256 string")
    assert [r["product_id"] for r in artifacts.mismatches(found, want).collect()] == ["p"]


def test_scene_files(spark, tmp_path):
    head, pixels = scenes.from_arrays(spark, "s", "optical", "2026-01-01", {"red": np.arange(6.0).reshape(2, 3)})
    scenes.write(head, pixels, str(tmp_path))
    again_head, again = scenes.read(spark, str(tmp_path))
    row = scenes.describe(again_head, again).first()
    assert (row["n_pixels"], row["red_mean"], row["height"], row["width"]) == (6, 2.5, 2, 3)
    with pytest.raises(FileNotFoundError):
        scenes.load_geotiff(spark, str(tmp_path / "none.tif"))


def test_patch_files(spark, tmp_path):
    tensors = spark.createDataFrame([(0, "train", [1.0, 2.0, 3.0, 4.0])], "patch_id long, split string, tensor array<float>")
    export.write_patches(tensors, str(tmp_path / "patches"))
    assert spark.read.parquet(str(tmp_path / "patches")).count() == 1
    assert export.write_npy(tensors, str(tmp_path / "npy"), 1, 2) == 1
    assert np.load(tmp_path / "npy/patch_000000.npy").tolist() == [[[1, 2], [3, 4]]]


def test_streamed_scenes_come_once(spark, tmp_path):
    row = {"scene_id": "s", "modality": "sar", "acquisition_date": "2026-01-01"}
    (tmp_path / "in").mkdir()
    where = (str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"scene_id": f"t{i}"}))
        ingest(spark, *where)
    assert sorted(r["scene_id"] for r in spark.read.parquet(where[1]).collect()) == ["s", "t0", "t1"]
