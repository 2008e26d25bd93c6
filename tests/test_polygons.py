"""Polygons against a cell-by-cell ray cast."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from overgrid.model import Grid
from overgrid.operators import vector, zonal
from overgrid.operators.vector import polygon_edges
from overgrid.plans import summary
from overgrid.sources import store

G = Grid(tile=8, zoom=3)  # 64 x 64 cells
RINGS = "zone_id bigint, rings array<array<struct<x: double, y: double>>>"
ZONES = {
    1: [[(3.0, 3.0), (60.0, 5.0), (58.0, 61.0), (2.0, 55.0)]],  # large: has whole tiles
    2: [[(5.0, 5.0), (50.0, 5.0), (50.0, 50.0), (5.0, 50.0)], [(10.0, 10.0), (40.0, 10.0), (40.0, 40.0), (10.0, 40.0)]],  # a hole
    3: [[(-20.0, -20.0), (20.0, -10.0), (10.0, 30.0)]],  # over the edge
    4: [[(8.0, 8.0), (16.0, 8.0), (16.0, 16.0), (8.0, 16.0), (8.0, 8.0)]],  # on tile borders, closed
    5: [[(30.2, 30.2), (30.4, 30.2), (30.3, 30.4)]],  # smaller than a cell
    6: [[(0.0, 0.0), (64.0, 64.0), (64.0, 0.0), (0.0, 64.0)]],  # crosses itself
    7: [[(200.0, 200.0), (210.0, 200.0), (205.0, 210.0)]],  # off the grid
    8: [[(-100.0, -100.0), (200.0, -100.0), (200.0, 200.0), (-100.0, 200.0)]],  # everything
}


def rays(rings, x, y):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                n += 1
    return n % 2 == 1


def covered(rings, grid=G):
    return {(i, j) for i in range(grid.size) for j in range(grid.size) if rays(rings, i + 0.5, j + 0.5)}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in ZONES.items()]
    return vector.polygon_edges(spark.createDataFrame(rows, RINGS)).cache()


def test_scan_conversion(edges):
    got = {}
    for r in vector.polygon_to_cells(edges, G).collect():
        got.setdefault(r["zone_id"], []).append((r["gx"], r["gy"]))
    for k, rings in ZONES.items():
        assert sorted(got.get(k, [])) == sorted(covered(rings)), k


def test_cover_and_outline_make_up_the_polygon(edges):
    cover = vector.polygon_cover(edges, G)
    whole, crossed = {}, {}
    for r in cover.collect():
        (whole if r["whole"] else crossed).setdefault(r["zone_id"], set()).add((r["tc"], r["tr"]))
    assert whole[1] and whole[8] and len(whole[8]) == 64 and 8 not in crossed
    cells = {k: [] for k in ZONES}
    for r in vector.outline_spans(edges, G).collect():
        assert r["tr"] == r["gy"] // 8 and (r["tc"], r["tr"]) in crossed[r["zone_id"]]
        cells[r["zone_id"]] += [(i, r["gy"]) for i in range(r["a"], r["b"] + 1)]
    for k, tiles in whole.items():
        for tc, tr in tiles:
            cells[k] += [(tc * 8 + i, tr * 8 + j) for i in range(8) for j in range(8)]
    for k, rings in ZONES.items():
        assert sorted(cells[k]) == sorted(covered(rings)), k


def test_touching_borders_counts(edges):
    touched = {}
    for r in vector.polygon_touched_tiles(edges, G).collect():
        touched.setdefault(r["zone_id"], set()).add((r["tc"], r["tr"]))
    assert touched[4] == {(i, j) for i in range(3) for j in range(3)}
    assert touched[5] == {(3, 3)}
    assert 7 not in touched


def random_layers(seed):
    rng = random.Random(seed)
    return {name: [[rng.choice(["-", None, 0, 1]) for _ in range(64)] for _ in range(40)] for name in ("a", "b")}


def test_zonal_sums(make_cells, edges):
    layers = random_layers(1)
    cells = make_cells(layers, G)
    got = {(r["zone_id"], r["layer"]): r for r in zonal.zonal_parts(cells, edges, G).collect()}
    for k, rings in ZONES.items():
        inside = covered(rings)
        for name, lines in layers.items():
            found = [lines[j][i] for i, j in inside if j < 40 and lines[j][i] not in ("-", None)]
            r = got.get((k, name))
            if k == 7:
                assert r is None
                continue
            assert (r["total"] or 0, r["data_cells"]) == (sum(found), len(found)), (k, name)
            assert r["tiles"] * 64 >= len(found)


def test_parts_of_the_data_combine_to_the_whole(make_cells, edges):
    cells = make_cells(random_layers(2), G)
    whole = zonal.zonal_sum(cells, edges, G).collect()
    upper = zonal.zonal_parts(cells.filter("gy < 16"), edges, G)
    lower = zonal.zonal_parts(cells.filter("gy >= 16"), edges, G)
    merged = zonal.combine_parts(upper.unionByName(lower)).drop("tiles").collect()
    key = lambda rows: sorted((r["zone_id"], r["layer"], r["total"], r["data_cells"]) for r in rows if r["data_cells"])
    assert key(whole) == key(merged)


def test_masked_cells(make_cells, edges):
    layers = {"a": [[1] * 64] * 64}
    got = {}
    for r in vector.mask_by_polygon(make_cells(layers, G), edges, G).collect():
        got.setdefault(r["zone_id"], {})[(r["gx"], r["gy"])] = r["value"]
    for k, rings in ZONES.items():
        assert {c for c, v in got.get(k, {}).items() if v == 1} == covered(rings), k
        assert len(got.get(k, {})) % 64 == 0


def test_both_denominators_and_untouched_zones(make_cells, edges):
    cells = make_cells({"a": [[1] * 64] * 64, "b": [[1] * 8] * 8}, G)
    weights = {"a": 2, "b": -1, "c": 5}
    for mode in ("tile_area", "study_area"):
        rows = summary.zonal_summary(cells, edges, weights, G, mode).collect()
        score = {(r["zone_id"], r["layer"]): r["score"] for r in rows}
        assert len(rows) == len(ZONES) * 4
        assert score[(7, "a")] is None and score[(7, None)] == 0
        assert score[(8, "c")] is None
        assert score[(8, "a")] == 2 and score[(8, None)] == (1 if mode == "tile_area" else 2 - 64 / 4096)
        if mode == "study_area":
            assert score[(1, "a")] == 2
        else:
            assert 0 < score[(1, "a")] < 2


def test_report(spark, make_cells, edges):
    cells = make_cells({"a": [[1] * 64] * 64, "b": [[0] * 64] * 64}, G)
    config = spark.createDataFrame([("a", "Woods")], "layer string, display string")
    rows = summary.summary_report(summary.zonal_summary(cells, edges, {"a": 1, "b": 3}, G), config).filter("zone_id = 8").collect()
    assert [(r["label"], r["weight"], r["score_text"]) for r in rows] == [("Woods", 1, "100.00"), ("Layer:", 3, "0.00"), ("Score:", None, "100.00")]


def test_bucketed_store_gives_the_same(spark, make_cells, edges, tmp_path):
    cells = make_cells(random_layers(4) | {"mask": [[1] * 64] * 64}, G)
    store.write_buckets(cells, "bucket_test", str(tmp_path / "cells"), 4)
    held = store.open_buckets(spark, "bucket_test", str(tmp_path / "cells"), 4)
    from overgrid.plans import overlay

    for build in (
        lambda c: overlay.weighted_overlay(c, {"a": 1, "b": 2}, G),
        lambda c: zonal.zonal_parts(c.filter("layer <> 'mask'"), edges, G),
        lambda c: store.layer_metadata(c),
    ):
        assert sorted(map(str, build(held).collect())) == sorted(map(str, build(cells).collect()))
    plan = overlay.weighted_overlay(held, {"a": 1, "b": 2}, G, dense=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = overlay.weighted_overlay(held, {"a": 1, "b": 2}, G)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    with pytest.raises(ValueError):
        store.open_buckets(spark, "bucket_test", str(tmp_path / "elsewhere"), 4)
    spark.sql("DROP TABLE bucket_test")


def test_one_polygon_reads_its_tiles_alone(spark, make_cells, tmp_path):
    """Tile bounds reach both scans of the store, and only tiles of the cover are shuffled."""
    far = make_cells(random_layers(4), G).union(make_cells(random_layers(4), G, left=128, top=128))
    store.write_layer(far, str(tmp_path / "layers"))
    cells = store.open_store(spark, str(tmp_path / "layers"))
    one = polygon_edges(spark.createDataFrame([(1, [[(2.2, 2.1), (30.5, 4.0), (12.0, 28.7)]])], "zone_id long, rings array<array<struct<x: double, y: double>>>"))
    bounds = zonal.zone_bounds(one, G)
    assert bounds == (0, 0, 30 // G.tile, 28 // G.tile)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    parts = zonal.zonal_parts(cells, one, G, bounds)
    assert sorted(map(str, parts.collect())) == sorted(map(str, zonal.zonal_parts(far, one, G).collect()))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert scans and all("GreaterThanOrEqual(tc,0)" in s and f"LessThanOrEqual(tr,{bounds[3]})" in s for s in scans)


def test_many_zones_over_one_tile(spark, make_cells):
    cells = make_cells(random_layers(1), G)
    rng = random.Random(5)
    rings = [(k, [[(rng.uniform(0, G.tile), rng.uniform(0, G.tile)) for _ in range(3)]]) for k in range(300)]
    zones = polygon_edges(spark.createDataFrame(rings, "zone_id long, rings array<array<struct<x: double, y: double>>>"))
    got = {(r["zone_id"], r["layer"]): r["total"] for r in zonal.zonal_sum(cells, zones, G).collect()}
    inside = vector.polygon_to_cells(zones, G).join(cells, ["gx", "gy"]).groupBy("zone_id", "layer").agg(F.sum("value").alias("t"))
    want = {(r["zone_id"], r["layer"]): r["t"] for r in inside.collect()}
    assert {k: v for k, v in got.items() if k in want} == want and all(v is None for k, v in got.items() if k not in want)


def test_runs_are_not_broadcast(spark, make_cells, tmp_path):
    """The size check sees a few edges, not the tiles and runs that come out of them."""
    path = str(tmp_path / "zones")
    spark.createDataFrame([(k, [[(1.0, 1.0), (60.0, 5.0), (30.0, 60.0)]]) for k in range(20)], RINGS).write.parquet(path)
    edges, cells = polygon_edges(spark.read.parquet(path)), make_cells(random_layers(2), G)
    for built in (zonal.zonal_parts(cells, edges, G), zonal.tile_counts(cells, edges, G), vector.mask_by_polygon(cells, edges, G)):
        plan = built._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line]
        assert joins and not [line for line in joins if "Broadcast" in line and "LeftSemi" not in line], joins


def test_masked_cells_are_not_moved_again(spark, make_cells):
    """One join by place; no shuffle by zone of cells that are already repeated for each zone."""
    zones = polygon_edges(spark.createDataFrame([(k, [[(1.0, 1.0), (60.0, 5.0), (30.0, 60.0)]]) for k in range(20)], RINGS))
    plan = vector.mask_by_polygon(make_cells(random_layers(2), G), zones, G)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1 and "SortMergeJoin [tc" in plan


def test_parts_that_grow_are_not_merged(spark, make_cells, edges):
    """Adaptive execution would merge these few bytes into one part."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for built in (zonal.prefix_rows(make_cells(random_layers(2), G)), vector.polygon_sweep(edges, G)):
        assert built.rdd.getNumPartitions() == int(parts)


def test_zones_need_an_id(spark):
    from pyspark.errors import PySparkException

    rings = spark.createDataFrame([(None, [[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]])], "zone_id long, rings array<array<struct<x: double, y: double>>>")
    with pytest.raises(PySparkException):
        polygon_edges(rings).collect()


def test_geojson_forms(spark):
    ring = "[[[1,2],[3,4,9],[5,6]]]"
    texts = [
        '{"type":"Polygon","coordinates":' + ring + "}",
        '{"type":"Feature","properties":{"a":1},"geometry":{"type":"Polygon","coordinates":' + ring + "}}",
        '{"type":"Point","coordinates":[1,2]}',
        "nonsense",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "zone_id int, geojson string")
    rows = vector.parse_geojson(df).orderBy("zone_id").collect()
    assert [r["is_valid"] for r in rows] == [True, True, False, False, False]
    for r in rows[:2]:
        assert [(p["x"], p["y"]) for p in r["rings"][0]] == [(1, 2), (3, 4), (5, 6)]
    assert vector.polygon_edges(vector.parse_geojson(df)).count() == 6


def test_a_jagged_outline_is_linear(spark):
    """A zigzag of thousands of edges in one row of tiles: no row of the plan is runs times tiles."""
    g = Grid(tile=8, zoom=9)
    teeth = [(float(4 * k), 1.2 if k % 2 else 6.8) for k in range(1000)]
    ring = [*teeth, (3996.0, 7.9), (0.0, 7.9)]
    edges = polygon_edges(spark.createDataFrame([(1, [ring])], RINGS))
    cover = vector.polygon_cover(edges, g)
    spans = vector.outline_spans(edges, g)
    whole = cover.filter("whole").count()
    cells = {(r["gx"], r["gy"]) for r in vector.polygon_to_cells(edges, g).collect()}
    pieces = spans.collect()
    assert {(x, r["gy"]) for r in pieces for x in range(r["a"], r["b"] + 1)} == cells and whole == 0
    runs = vector.polygon_spans(edges, g.size).count()
    assert len(pieces) <= runs + 8 * cover.count()
