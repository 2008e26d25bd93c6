from __future__ import annotations

import json
import re
from types import SimpleNamespace

import pytest

from overgrid.model import Grid
from overgrid.sources import config, ingest, store

G = Grid(tile=4, zoom=2)


def test_storage_paths():
    assert store.storage_path("file", "/data/x") == "file:/data/x"
    assert store.storage_path("hadoop", "/data/x") == "hdfs:/data/x"
    assert store.storage_path("s3", "bucket/x") == "s3a://bucket/x"
    assert store.storage_path("hadoop", "file:///data/x") == "file:///data/x"
    with pytest.raises(ValueError):
        store.storage_path("tape", "/x")


def test_store_round_trip_prunes_layers(spark, make_cells, tmp_path):
    cells = make_cells({"01": [[1, None, 3, 4, 5]], "b": [[7]]}, G)
    path = str(tmp_path / "layers")
    store.write_layer(cells, path)
    back = store.open_store(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, cells.collect()))
    assert back.schema == cells.schema
    some = store.query_layer_bounds(back, "01", G.zoom, (1, 0, 1, 0))
    assert [r["value"] for r in some.collect()] == [5]
    plan = some._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "layer" in pruned and "zoom" in pruned and "GreaterThanOrEqual(tc,1)" in plan


def test_tile_keys(spark, make_cells):
    cells = make_cells({"a": [[1, 2, 3, 4, 5]]}, G)
    keys = spark.createDataFrame([("a", 2, 1, 0), ("a", 2, 3, 3)], "layer string, zoom int, tc int, tr int")
    assert [r["value"] for r in store.read_tile(cells, keys).collect()] == [5]
    assert [(r["tc"], r["tr"]) for r in store.missing_tiles(cells, keys).collect()] == [(3, 3)]


def test_shared_folder_follows_the_session(spark):
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://nn/shared/"})
    assert store.shared_folder(named).startswith("hdfs://nn/shared/overgrid-")
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(ValueError):
        store.shared_folder(SimpleNamespace(conf={}, sparkContext=context))
    assert store.shared_folder(spark) != store.shared_folder(spark)


def test_config_file(spark, tmp_path):
    layers = [{"name": "a", "weight": "-5", "display": "A"}, {"name": "b", "weight": "oops", "display": "B"}]
    text = {"title": "t", "weightedOverlay": {"numBreaks": "10", "opacity": "0.75", "ramp": "blue-to-red", "layers": layers}}
    (tmp_path / "c.json").write_text(json.dumps(text, indent=2))
    rows = config.read_config(spark, str(tmp_path / "c.json")).orderBy("pos").collect()
    assert [(r["layer"], r["weight"], r["num_breaks"], r["opacity"]) for r in rows] == [("a", -5, 10, 0.75), ("b", None, 10, 0.75)]


def test_ingest_from_files_to_a_store(spark, tmp_path):
    csv = tmp_path / "p.csv"
    csv.write_text("id,lon,lat,v\n1,-85.3,34.7,1\n2,-85.3,34.7,0\n3,10,50,1\n")
    source = {
        "name": "wet", "format": "csv", "options": {"header": "true"}, "backend": {"type": "file", "path": str(csv)},
        "crs": "EPSG:4326", "columns": {"id": "id", "x": "lon", "y": "lat", "value": "v"},
    }
    conic = {
        "name": "dry", "format": "csv", "options": {"header": "true"}, "backend": {"type": "file", "path": str(csv)},
        "crs": "albers", "columns": {"id": "id", "x": "977000 + id", "y": "1337900", "value": "v"},
    }
    output = {"backend": {"type": "file", "path": str(tmp_path / "out")}, "tileSize": 256, "cellSize": {"width": 256.0}, "pyramid": True}
    ingest.run_ingest(spark, [source, conic], output)
    back = store.open_store(spark, str(tmp_path / "out"))
    meta = {(r["layer"], r["zoom"]): r for r in store.layer_metadata(back).collect()}
    assert meta[("wet", 9)]["data_cells"] == 2 and meta[("dry", 9)]["data_cells"] == 1
    assert set(z for _, z in meta) == set(range(10)) and meta[("wet", 0)]["tiles"] == 1
    assert all(m["cells"] == m["tiles"] * 256 * 256 for m in meta.values()), "tiles are dense at every zoom"
    first = back.filter("layer = 'wet' AND zoom = 9 AND gx < 60000 AND value IS NOT NULL").collect()
    assert [r["value"] for r in first] == [1]
    with pytest.raises(ValueError):
        ingest.read_source(spark, source | {"crs": "EPSG:1"})
