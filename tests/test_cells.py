"""Hand-made grids for the NODATA rules, and identities of the map algebra."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from overgrid.functions import zcurve
from overgrid.model import CELLS, WORLD_HALF, Grid
from overgrid.operators import color, grid as grid_ops, local, requests, stats, tiles
from overgrid.plans import overlay, scenarios

G = Grid(tile=4, zoom=2)


def values(df, *keys):
    keys = keys or ("gx", "gy")
    return {tuple(r[k] for k in keys): r["value"] for r in df.collect()}


def test_add_propagates_or_ignores_nodata(make_cells):
    cells = make_cells({"a": [[1, None, 3]], "b": [[10, 20, "-"]]}, G)
    assert values(local.local_add(cells)) == {(0, 0): 11, (1, 0): None, (2, 0): 3}
    assert values(local.local_add(cells, nodata="ignore")) == {(0, 0): 11, (1, 0): 20, (2, 0): 3}


def test_zero_weight_drops_the_layer_with_its_nodata(make_cells):
    cells = make_cells({"a": [[1, 1]], "b": [[None, 5]], "mask": [[1] * 4] * 4}, G)
    assert values(overlay.weighted_overlay(cells, {"a": 2, "b": 0}, G)) == {(0, 0): 2, (1, 0): 2}
    assert values(overlay.weighted_overlay(cells, {"a": 2, "b": 1}, G)) == {(0, 0): None, (1, 0): 7}


def test_mask_hides_and_missing_mask_tiles_drop(make_cells):
    cells = make_cells({"a": [[1, 1, 1, 1, 1]], "mask": [[1, None, 1, 1]] + [[1] * 4] * 3}, G)
    want = {(0, 0): 1, (1, 0): None, (2, 0): 1, (3, 0): 1}
    assert values(overlay.weighted_overlay(cells, {"a": 1}, G)) == want
    layer, mask = cells.filter("layer = 'a'"), cells.filter("layer = 'mask'")
    assert values(local.local_mask(layer, mask)) == want
    assert values(local.local_mask(layer, mask, dense=True)) == want


def test_mask_cannot_be_weighted(make_cells):
    with pytest.raises(ValueError):
        overlay.weighted_overlay(make_cells({"mask": [[1]]}, G), {"mask": 1}, G)


def test_sparse_mask_counts_missing_cells_as_nodata(make_cells):
    layer, mask = make_cells({"a": [[1, 1]]}, G), make_cells({"mask": [[1, "-"]]}, G)
    assert values(local.local_mask(layer, mask)) == {(0, 0): 1, (1, 0): None}


def test_overlay_tiles_turn_cancelled_sums_to_nodata(make_cells):
    cells = make_cells({"a": [[1, 1]], "b": [[1, 0]], "mask": [[1] * 4] * 4}, G)
    weights = {"a": 3, "b": -3}
    assert values(overlay.overlay_tiles(cells, weights, G)) == {(0, 0): None, (1, 0): 3}
    assert values(overlay.weighted_overlay(cells, weights, G)) == {(0, 0): 0, (1, 0): 3}


def test_conversion_drops_what_does_not_fit(make_cells):
    cells = make_cells({"a": [[40000, -32768, 7, -9]]}, G)
    assert values(local.convert_cell_type(cells)) == {(0, 0): None, (1, 0): -32768, (2, 0): 7, (3, 0): -9}
    back = local.convert_cell_type(cells, read_nodata=-9, write_nodata=-1)
    assert values(back) == {(0, 0): -1, (1, 0): -32768, (2, 0): 7, (3, 0): -1}


def test_pyramid_takes_first_child_and_keeps_nodata(make_cells):
    cells = make_cells({"a": [[None, 2, "-", 4], [5, 6, 7, 8], ["-"] * 4, ["-", "-", "-", 9]]}, G)
    up = values(grid_ops.pyramid(cells, G), "zoom", "gx", "gy")
    assert up[(1, 0, 0)] is None and up[(1, 1, 0)] == 4 and up[(1, 1, 1)] == 9
    assert up[(0, 0, 0)] is None
    assert len([k for k in up if k[0] == 2]) == 8  # the base, unchanged


@pytest.mark.parametrize("at_once", [1, 2, 3, 10])
def test_pyramid_is_the_same_whatever_the_step(spark, make_cells, at_once):
    rng = random.Random(5)
    deep = Grid(tile=4, zoom=3)
    lines = [[rng.choice(["-", "-", None, 0, 1]) for _ in range(32)] for _ in range(32)]
    cells = make_cells({"a": lines, "b": lines[::-1]}, deep)
    got = values(grid_ops.pyramid(cells, deep, levels_at_once=at_once), "layer", "zoom", "gx", "gy")
    want = values(cells, "layer", "zoom", "gx", "gy")
    level = dict(want)
    for zoom in (2, 1, 0):
        parents = {}
        for (layer, _, x, y), v in sorted(level.items(), key=lambda e: (e[0][3] % 2, e[0][2] % 2)):
            parents.setdefault((layer, zoom, x // 2, y // 2), v)
        level = parents
        want |= parents
    assert got == want


def test_breaks_match_sorted_values(spark):
    rng = random.Random(3)
    for spread in (3, 200000):
        data = [rng.randint(-spread, spread) for _ in range(500)] + [None] * 5
        cells = spark.createDataFrame([(v,) for v in data], "value int")
        got = [r["brk"] for r in stats.quantile_breaks(stats.histogram_exact(cells), 7).orderBy("k").collect()]
        ordered = sorted(v for v in data if v is not None)
        assert got == [ordered[-(-k * len(ordered) // 7) - 1] for k in range(1, 8)]


def test_breaks_repeat_when_values_are_few(spark):
    cells = spark.createDataFrame([(4,)] * 3, "value int")
    rows = stats.quantile_breaks(stats.histogram_exact(cells), 5).orderBy("k").collect()
    assert [(r["k"], r["brk"]) for r in rows] == [(k, 4) for k in range(1, 6)]


def test_classes_and_colors(spark):
    legend = spark.createDataFrame([("s", 1, 2, 11), ("s", 2, 2, 22), ("s", 3, 9, 33)], "id string, k int, brk int, rgba bigint")
    cells = spark.createDataFrame([("s", v) for v in (1, 2, 3, 10, None)], "id string, value int")
    got = {r["value"]: (r["class"], r["rgba"]) for r in color.classify_cells(cells, legend, ("id",), fallback=99).collect()}
    assert got == {1: (1, 11), 2: (1, 11), 3: (3, 33), 10: (None, 99), None: (None, 0)}
    plain = cells.select("value", color.classify(F.col("value"), [2, 2, 9], [11, 22, 33], 99).alias("c"), color.class_index(F.col("value"), [2, 2, 9]).alias("i"))
    assert {r["value"]: (r["i"], r["c"]) for r in plain.collect()} == got


def test_ramp_interpolation(spark):
    ramps = spark.createDataFrame([("x", 0, 0, 0, 0), ("x", 1, 100, 50, 201)], "ramp string, stop int, r int, g int, b int")
    asked = spark.createDataFrame([(1, "x", 3), (2, "x", 1), (3, "x", 2)], "req_id int, ramp string, num_breaks int")
    rows = color.interpolate_ramp(asked, ramps).orderBy("req_id", "k").collect()
    split = [(r["req_id"], (r["rgba"] >> 24) & 255, (r["rgba"] >> 16) & 255, (r["rgba"] >> 8) & 255, r["rgba"] & 255) for r in rows]
    assert split == [(1, 0, 0, 0, 255), (1, 50, 25, 101, 255), (1, 100, 50, 201, 255), (2, 0, 0, 0, 255), (3, 0, 0, 0, 255), (3, 100, 50, 201, 255)]


def test_twelve_ramps():
    assert len(color.PALETTES) == 12 and color.DEFAULT_RAMP in color.PALETTES


def test_dense_pack_unpack(make_cells):
    cells = make_cells({"a": [["-", 1, None, "-", "-", 3], ["-"] * 6, [7, "-", "-", "-"]]}, G)
    dense = tiles.densify_tiles(cells, G)
    got = values(dense)
    assert len(got) == 32 and got[(1, 0)] == 1 and got[(0, 2)] == 7 and got[(5, 0)] == 3 and got[(3, 3)] is None
    assert values(tiles.unpack_tiles(tiles.pack_tiles(dense, G), G)) == got
    filled = values(tiles.densify_tiles(cells, G, fill=0))
    assert filled[(2, 0)] is None and filled[(0, 0)] == 0 and filled[(7, 3)] == 0


def test_pairs_cut_to_the_shorter_list(spark):
    table = spark.createDataFrame([(1, "a,b", "5,x,7"), (2, "a,b,c", "1,0")], "req_id int, layers string, weights string")
    pairs = requests.layer_weight_pairs(table)
    assert [tuple(r) for r in pairs.orderBy("req_id", "pos").collect()] == [(1, 0, "a", 5), (1, 1, "b", None), (2, 0, "a", 1), (2, 1, "b", 0)]
    assert {r["req_id"]: (r["layers"], r["weights"]) for r in requests.active_layers(pairs, "req_id").collect()} == {1: ("a", "5"), 2: ("a", "1")}
    with pytest.raises(Exception):
        requests.layer_weight_pairs(table, strict=True).collect()
    labels = pairs.select(requests.weight_label(F.col("weight")).alias("l"))
    assert sorted(str(r["l"]) for r in labels.collect()) == ["+1", "+5", "0", "None"]


def test_scenarios_equal_single_runs(spark, make_cells):
    rng = random.Random(8)
    lines = {name: [[rng.choice(["-", None, 0, 1, 2]) for _ in range(8)] for _ in range(8)] for name in "abc"}
    lines["mask"] = [[rng.choice([1, 1, None]) for _ in range(8)] for _ in range(4)]
    cells = make_cells(lines, G)
    vectors = {1: {"a": 1, "b": -2, "c": 0}, 2: {"a": 0, "b": 3, "c": 3}, 3: {"c": -1}}
    table = spark.createDataFrame([(s, n, w) for s, ws in vectors.items() for n, w in ws.items()], "scenario_id int, layer string, weight int")
    over = values(scenarios.scenario_overlay(cells, ["a", "b", "c"], table, G), "scenario_id", "gx", "gy")
    breaks = scenarios.scenario_breaks(cells, ["a", "b", "c"], table, 4, G.zoom).collect()
    for s, weights in vectors.items():
        assert {k[1:]: v for k, v in over.items() if k[0] == s} == values(overlay.weighted_overlay(cells, weights, G))
        single = {(r["k"], r["brk"]) for r in overlay.weighted_breaks(cells, weights, 4, G.zoom).collect()}
        assert {(r["k"], r["brk"]) for r in breaks if r["scenario_id"] == s} == single


def test_nearest_sample_and_ties(spark):
    grid = Grid(tile=4, zoom=0)
    size = grid.cell_size
    x0, y0 = -2 * size, 2 * size
    rows = [("a", 3, x0 + 0.5 * size, y0 - 0.4 * size, 30), ("a", 2, x0 + 0.5 * size, y0 - 0.6 * size, 20), ("a", 1, x0 + 0.9 * size, y0 - 0.9 * size, 10)]
    points = spark.createDataFrame(rows, "layer string, id int, x double, y double, value int")
    assert values(grid_ops.resample_nearest(points, grid, "id")) in ({(0, 0): 20}, {(0, 0): 30})
    same = points.withColumn("y", F.lit(y0 - 0.5 * size)).withColumn("x", F.lit(x0 + 0.5 * size))
    assert values(grid_ops.resample_nearest(same, grid, "id")) == {(0, 0): 10}


def test_world_edges(spark):
    grid = Grid(tile=256, zoom=1)
    half = 20037508.342789244
    points = spark.createDataFrame([(-half, half), (half, 0.0), (0.0, 0.0), (0.0, -half)], "x double, y double")
    got = {(r["x"], r["y"]): (r["gx"], r["gy"], r["tc"], r["tr"]) for r in grid_ops.assign_tile_key(points, grid).collect()}
    assert got == {(-half, half): (0, 0, 0, 0), (0.0, 0.0): (256, 256, 1, 1)}


def test_base_zoom_of_256_metre_cells(spark):
    got = spark.range(1).select(grid_ops.choose_zoom(F.lit(256.0)).alias("z")).first()["z"]
    assert got == 9


def test_extent_round_trip(spark):
    keys = spark.createDataFrame([(3, 5), (0, 0), (7, 7)], "tc int, tr int")
    grid = Grid(tile=256, zoom=3)
    inner = grid_ops.key_to_extent(keys, grid).selectExpr("tc", "tr", "xmin + 1 AS xmin", "ymin + 1 AS ymin", "xmax - 1 AS xmax", "ymax - 1 AS ymax")
    for r in grid_ops.extent_to_bounds(inner, grid).collect():
        assert (r["c0"], r["r0"], r["c1"], r["r1"]) == (r["tc"], r["tr"], r["tc"], r["tr"])
    whole = grid_ops.extent_union(grid_ops.key_to_extent(keys, grid)).first()
    assert round(whole["xmin"], 3) == -20037508.343 and round(whole["ymin"], 3) == -20037508.343


def test_albers_known_point(spark):
    # Snyder (1987), page 292: Clarke 1866 ellipsoid, 35 N 75 W.
    from overgrid.functions.projection import Albers

    conic = Albers(semi_major=6378206.4, inverse_flattening=294.978698)
    df = spark.createDataFrame([(-75.0, 35.0)], "lon double, lat double")
    r = grid_ops.albers_project(df, conic=conic).first()
    assert abs(r["x"] - 1885472.7) < 0.2 and abs(r["y"] - 1535925.0) < 0.2
    sphere = Albers().forward_sphere(F.col("lon"), F.col("lat"), 1.0)
    r = df.select(sphere[0].alias("x"), sphere[1].alias("y")).first()
    assert abs(r["x"] - 0.2952720) < 1e-6 and abs(r["y"] - 0.2416774) < 1e-6


def test_sparse_mask_is_read_by_tile(make_cells):
    cells = make_cells({"a": [[1, 1]], "mask": [[1, "-"]]}, G)
    want = {(0, 0): 1, (1, 0): None}
    assert values(overlay.weighted_overlay(cells, {"a": 1}, G)) == want
    layer, mask = cells.filter("layer = 'a'"), cells.filter("layer = 'mask'")
    assert values(local.local_mask(local.local_add(layer), mask)) == want


def test_pack_keeps_the_places_of_sparse_cells(make_cells):
    cells = make_cells({"a": [["-"] * 4, ["-", 7, "-", None], ["-"] * 4, ["-", "-", "-", 9]]}, G)
    packed = tiles.pack_tiles(cells, G)
    assert packed.first()["cells"] == [7 if i == 5 else 9 if i == 15 else None for i in range(16)]
    back = values(tiles.unpack_tiles(packed, G))
    assert len(back) == 16 and {k: v for k, v in back.items() if v is not None} == {(1, 1): 7, (3, 3): 9}


def test_repeated_cells_count_once(make_cells):
    cells = make_cells({"a": [["-", 1]]}, G).union(make_cells({"a": [["-", 5]]}, G)).union(make_cells({"a": [["-", "-", 2]]}, G))
    dense = tiles.densify_tiles(cells, G)
    assert dense.count() == 16 and values(dense)[1, 0] == 5 and values(dense)[2, 0] == 2
    assert tiles.pack_tiles(cells, G).first()["cells"][:3] == [None, 5, 2]


def test_points_without_a_place_are_dropped_and_counted(spark):
    rows = [("a", 0.0, 0.0), ("a", float("nan"), 0.0), ("a", 0.0, None), ("a", 3e7, 0.0), ("b", 1.0, float("nan"))]
    points = spark.createDataFrame(rows, "layer string, x double, y double")
    assert grid_ops.assign_tile_key(points, Grid(4, 2)).count() == 1
    got = {r["layer"]: (r["points"], r["not_numbers"], r["off_world"]) for r in grid_ops.count_dropped(points, Grid(4, 2)).collect()}
    assert got == {"a": (4, 2, 1), "b": (1, 1, 0)}


def test_coarse_sources_leave_no_hole(spark):
    g = Grid(tile=4, zoom=2)
    side = 4 * g.cell_size
    rows = [("a", i * 4 + j, (i + 0.5) * side, (j + 0.5) * side, i * 4 + j) for i in range(-2, 2) for j in range(-2, 2)]
    points = spark.createDataFrame(rows, "layer string, id int, x double, y double, value int")
    cells = grid_ops.resample_nearest(points, g, "id", source_cell=side)
    got = values(cells)
    assert len(got) == 16 * 16
    assert all(v == (x // 4 - 2) * 4 + (1 - y // 4) for (x, y), v in got.items())
    assert grid_ops.resample_nearest(points, g, "id").count() == 16


def test_poles_are_taken_as_the_border_of_the_world(spark):
    rows = grid_ops.reproject_points(spark.createDataFrame([(0.0, -90.0), (0.0, 90.0), (0.0, 85.0)], "lon double, lat double")).collect()
    assert [round(r["y"] / WORLD_HALF, 9) for r in rows][:2] == [-1.0, 1.0] and rows[2]["y"] < WORLD_HALF


def test_empty_entries_at_the_end_do_not_count(spark):
    table = spark.createDataFrame([(1, "A,B,", "1,2,"), (2, "A", " 1"), (3, ",", "1"), (4, "A,,B", "1,,2")], "req int, layers string, weights string")
    got = [(r["req"], r["layer"], r["weight"]) for r in requests.layer_weight_pairs(table).orderBy("req", "pos").collect()]
    assert got == [(1, "A", 1), (1, "B", 2), (2, "A", None), (4, "A", 1), (4, "", None), (4, "B", 2)]


def test_more_layers_than_a_word_has_bits(spark, make_cells):
    names = [f"l{i:03d}" for i in range(70)]
    cells = make_cells({n: [[i % 3, None if i == 65 else 1]] for i, n in enumerate(names)}, G)
    table = spark.createDataFrame([(1, n, 1) for n in names] + [(2, names[69], 5)], "scenario_id int, layer string, weight int")
    over = values(scenarios.scenario_overlay(cells, names, table, G, mask_layer=None), "scenario_id", "gx", "gy")
    assert over == {(1, 0, 0): sum(i % 3 for i in range(70)), (1, 1, 0): None, (2, 0, 0): 0, (2, 1, 0): 5}


def test_keys_of_mixed_zooms(spark):
    keys = spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "zoom int, tc int, tr int")
    rows = grid_ops.key_to_extent(keys, Grid(256, 9)).orderBy("zoom").collect()
    assert (rows[0]["xmin"], rows[0]["ymax"], rows[0]["xmax"]) == (-WORLD_HALF, WORLD_HALF, WORLD_HALF)
    assert (rows[1]["xmin"], rows[1]["ymax"], rows[1]["xmax"]) == (0.0, 0.0, WORLD_HALF)


def test_signatures_are_named_by_one_number(spark, make_cells):
    cells = make_cells({"a": [[1, 2, None, 1]], "b": [[1, 1, 1, "-"]]}, G)
    pixels, known = scenarios.signature_ids(scenarios.signatures(cells, ["a", "b"]), ["a", "b"])
    assert pixels.columns == ["zoom", "gx", "gy", "sig"]
    assert known.count() == known.select("sig").distinct().count() == 4
    table = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "a", 1)], "scenario_id INT, layer STRING, weight INT")
    plan = scenarios.scenario_overlay(cells, ["a", "b"], table, G, mask_layer=None)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any(f"v{i}#" in line for line in joins for i in range(2))


def test_two_signatures_of_one_id_are_an_error(spark, make_cells, monkeypatch):
    cells = make_cells({"a": [[1, 2]]}, G)
    hashed = F.xxhash64
    calls = iter([lambda *columns: F.lit(7).cast("bigint"), hashed])  # the first hash names, the second checks
    monkeypatch.setattr(scenarios.F, "xxhash64", lambda *columns: next(calls)(*columns))
    _, known = scenarios.signature_ids(scenarios.signatures(cells, ["a"]), ["a"])
    with pytest.raises(Exception, match="another seed"):
        known.collect()


def test_classes_of_nodata_and_of_cells_without_legend(spark):
    cells = spark.createDataFrame([("x", 1, None), ("x", 2, 5), ("x", 3, 99), ("y", 4, 5), (None, 5, 5)], "id STRING, at INT, value INT")
    legend = spark.createDataFrame([("x", 1, 5, 111), ("x", 2, 9, 222)], "id STRING, k INT, brk INT, rgba BIGINT")
    classed = color.classify_cells(cells, legend, ("id",), fallback=7)
    assert sorted((r["at"], r["class"], r["rgba"]) for r in classed.collect()) == [(1, None, 0), (2, 1, 111), (3, None, 7)]
    assert classed.columns == ["id", "at", "value", "class", "rgba"]


def test_breaks_of_wide_values_by_group(spark):
    """64-bit values of every magnitude and sign, a number of breaks for each group, hot values."""
    rng = random.Random(9)
    data = [(g, rng.choice((-1, 1)) * rng.getrandbits(rng.randint(1, 63))) for g in ("a", "b") for _ in range(400)]
    data += [("a", -(1 << 63)), ("b", (1 << 63) - 1), ("c", 5)] + [("b", 7)] * 300
    cells = spark.createDataFrame(data, "g string, value bigint")
    asked = {"a": 11, "b": 4, "c": 3}
    counts = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])[F.col("g")]
    hist = stats.histogram_exact(cells, ("g",)).withColumn("breaks", counts)
    told = stats.quantile_breaks(hist, "breaks", ("g",))
    got = {(r["g"], r["k"]): r["brk"] for r in told.collect()}
    want = {}
    for g, n in asked.items():
        ordered = sorted(v for name, v in data if name == g)
        want |= {(g, k): ordered[-(-k * len(ordered) // n) - 1] for k in range(1, n + 1)}
    assert got == want
    ran = told._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in ran.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert 0 < len(shuffles) <= 9


def test_unpacked_tiles_are_packed_once(spark):
    """No filter repeats the packing, and a repeated, a NULL and a single cell come back as they are."""
    grid = Grid(tile=64, zoom=2)
    rows = [("a", 2, 1, 0, 64, 0, 5), ("a", 2, 1, 0, 64, 0, 7), ("a", 2, 1, 0, 70, 3, None), ("b", 2, 0, 0, 63, 63, 2)]
    full = [("c", 2, 0, 0, x, y, x * y) for x in range(64) for y in range(64)]
    back = tiles.unpack_tiles(tiles.pack_tiles(spark.createDataFrame(rows + full, CELLS), grid), grid)
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "flatten" in line]
    got = {(r.layer, r.gx, r.gy): r.value for r in back.collect()}
    assert len(got) == 3 * 4096
    assert {k: v for k, v in got.items() if v is not None and k[0] != "c"} == {("a", 64, 0): 7, ("b", 63, 63): 2}
    assert all(got["c", x, y] == x * y for x in range(64) for y in range(64))


def test_curve_keys_are_looked_up_by_bytes(spark):
    rows = [(0, 0), (5, 3), (255, 256), (2**31 - 1, 2**31 - 1), (-1, 7), (None, 1)]
    df = spark.createDataFrame(rows, "x INT, y INT")
    keyed = df.withColumn("z", zcurve.z_encode("x", "y"))
    back = keyed.withColumns({"bx": zcurve.z_decode_x("z"), "by": zcurve.z_decode_y("z")})
    for r in back.collect():
        if r.x is None:
            assert r.z is None
        else:
            x, y = r.x & (2**31 - 1), r.y & (2**31 - 1)
            assert (r.z, r.bx, r.by) == (zcurve.z_number(x, y), x, y)
    # One term for each byte: with one for each bit the generated method was too long for the JVM to compile.
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("shiftright") == 8


def test_tiles_are_together_before_they_are_multiplied(spark, tmp_path):
    """A task sums its own tiles: no shuffle by scenario of sums that every task has of every tile."""
    from __spark_entry__ import queries

    rows = [(k, k % 3, float(k % 50), "AN"[k % 2], "FO"[k % 2]) for k in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(25).selectExpr("CAST(id AS INT) AS n_nationkey").write.parquet(str(tmp_path / "nation.parquet"))
    sums = queries()["multiply_scalar_table"](spark, str(tmp_path))
    by_key = {(r.scenario_id, r.layer, r.tc, r.tr): (r.total, r.n) for r in sums.collect()}
    weights = [-5 + (s * 3 + pos * 5) % 11 for s in range(25) for pos in (0, 3)]  # AF, NO
    assert sum(n for _, n in by_key.values()) == 400 * 25
    values = [sum(1 for k in range(400) if k % 2 == odd and 10 <= k % 50 < 46) for odd in (0, 1)]
    assert sum(t or 0 for t, _ in by_key.values()) == sum(w * values[i % 2] for i, w in enumerate(weights))
    assert "hashpartitioning(scenario_id" not in sums._jdf.queryExecution().executedPlan().toString()
