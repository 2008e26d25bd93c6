"""Merged statistics, pyramids rebuilt in part and overlays over runs, against the whole recount."""

from __future__ import annotations

import random

import pytest

from overgrid.model import CELLS, Grid
from overgrid.operators import changes, grid as grid_ops, runs
from overgrid.plans import overlay
from overgrid.sources import store

DEEP = Grid(tile=4, zoom=3)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def random_lines(seed, side=32, kinds=("-", "-", None, 0, 1, 2)):
    rng = random.Random(seed)
    return [[rng.choice(kinds) for _ in range(side)] for _ in range(side)]


def test_batches_merge_to_a_full_recount_and_may_be_written_again(spark, make_cells, tmp_path):
    cells = make_cells({"a": random_lines(1), "b": random_lines(2)}, DEEP)
    path = f"{tmp_path}/store"
    for batch, rule in (("x", "gx % 3 = 0"), ("y", "gx % 3 = 1"), ("x", "gx % 3 = 0"), ("z", "gx % 3 = 2")):
        store.write_batch(cells.filter(rule), path, batch)
    held = store.open_store(spark, path)
    assert rows(held) == rows(cells)
    assert rows(store.open_statistics(spark, path)) == rows(changes.tile_statistics(cells))
    assert rows(changes.metadata_of(store.open_statistics(spark, path), 4)) == rows(store.layer_metadata(cells, 4))


def test_statistics_read_no_cells(spark, make_cells, tmp_path):
    path = f"{tmp_path}/store"
    store.write_batch(make_cells({"a": random_lines(3)}, DEEP), path, "one")
    files = store.open_statistics(spark, path).inputFiles()
    assert files and all(".statistics/" in f for f in files)


def test_statistics_of_nothing(spark):
    empty = changes.tile_statistics(spark.createDataFrame([], CELLS))
    assert changes.metadata_of(changes.merge_statistics(empty, empty), 4).collect() == []


def test_tile_without_data_totals_nothing(make_cells):
    told = changes.layer_totals(changes.tile_statistics(make_cells({"a": [[None, None]]}, DEEP))).collect()
    assert [tuple(r) for r in told] == [("a", 3, 2, 0, 0)]


@pytest.mark.parametrize(("tile", "to_zoom"), [(1, 0), (1, 2), (2, 0), (2, 1), (4, 0), (4, 1), (4, 3), (32, 0)])
def test_refreshed_pyramid_equals_a_new_one(make_cells, tile, to_zoom):
    """Changed, deleted and new tiles; levels inside a tile and above many."""
    layout = Grid(tile=tile, zoom=3)
    side = min(32, tile << 3)
    before = make_cells({"a": random_lines(4, side), "b": random_lines(5, side)}, layout)
    touched = "(layer = 'a' AND (tc + tr) % 3 = 0) OR (layer = 'b' AND tc = 1)"
    gone = "layer = 'b' OR (tc = 0 AND tr = 0)"
    fresh = make_cells({"a": random_lines(6, side), "b": random_lines(7, side)}, layout).filter(f"({touched}) AND NOT ({gone})")
    after = before.filter(f"NOT ({touched})").unionByName(fresh)
    changed = before.unionByName(fresh).filter(touched).select("layer", "tc", "tr").distinct()
    old = grid_ops.pyramid(before, layout, to_zoom, keep_base=False) if to_zoom < 3 else before.filter("false")
    want = grid_ops.pyramid(after, layout, to_zoom, keep_base=False) if to_zoom < 3 else before.filter("false")
    assert rows(changes.refresh_pyramid(after, old, changed, layout, to_zoom)) == rows(want)


def test_only_places_above_changed_tiles_are_rebuilt(spark, make_cells):
    cells = make_cells({"a": random_lines(8, kinds=(0, 1))}, DEEP)
    old = grid_ops.pyramid(cells, DEEP, keep_base=False)
    changed = spark.createDataFrame([("a", 5, 2)], "layer string, tc int, tr int")
    got = changes.rebuilt_cells(cells, old, changed, DEEP).groupBy("zoom").count().collect()
    assert {r["zoom"]: r["count"] for r in got} == {2: 4, 1: 1, 0: 1}


def test_a_pyramid_needs_tiles_of_a_power_of_two(make_cells):
    odd = Grid(tile=5, zoom=1)
    cells = make_cells({"a": [[1]]}, odd)
    with pytest.raises(ValueError):
        changes.refresh_pyramid(cells, cells, cells, odd)


def test_runs_end_at_tiles_holes_and_nodata(make_cells):
    cells = make_cells({"a": [[1, 1, 1, 1, 1, 1, "-", 1, None, None, 0]]}, DEEP)
    held = runs.cells_to_runs(cells)
    got = sorted((r["x0"], r["x1"], r["value"]) for r in held.collect())
    assert got == [(0, 3, 1), (4, 5, 1), (7, 7, 1), (8, 9, None), (10, 10, 0)]
    assert rows(runs.runs_to_cells(held).select(*cells.columns)) == rows(cells)


@pytest.mark.parametrize("nodata", ["propagate", "ignore"])
def test_overlay_of_runs_equals_that_of_cells(make_cells, nodata):
    lines = {"a": random_lines(9), "b": random_lines(10), "c": random_lines(11), "mask": random_lines(12, kinds=("-", None, 1, 1))}
    cells = make_cells(lines, DEEP).filter("layer <> 'mask' OR (tc + tr) % 4 <> 0")
    weights = {"a": 2, "b": -1, "c": 0}
    got = runs.runs_to_cells(runs.overlay_runs(runs.cells_to_runs(cells), weights, DEEP.zoom, nodata))
    want = overlay.weighted_overlay(cells, weights, DEEP, nodata=nodata)
    assert rows(got.select(*want.columns)) == rows(want)
    whole = make_cells({**lines, "mask": random_lines(13, kinds=(None, 1))}, DEEP)
    got = runs.runs_to_cells(runs.overlay_runs(runs.cells_to_runs(whole), weights, DEEP.zoom, nodata, dense=True))
    want = overlay.weighted_overlay(whole, weights, DEEP, nodata=nodata, dense=True)
    assert rows(got.select(*want.columns)) == rows(want)


def test_overlay_of_stored_runs_shuffles_once(make_cells):
    held = runs.cells_to_runs(make_cells({"a": [[1, 1]], "mask": [[1, 1]]}, DEEP))
    plain = held.sparkSession.createDataFrame(held.collect(), held.schema)
    plan = runs.overlay_runs(plain, {"a": 1}, DEEP.zoom, dense=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_overlay_of_runs_refuses_what_the_overlay_refuses(make_cells):
    held = runs.cells_to_runs(make_cells({"mask": [[1]]}, DEEP))
    with pytest.raises(ValueError):
        runs.overlay_runs(held, {"mask": 1}, DEEP.zoom)
    with pytest.raises(ValueError):
        runs.overlay_runs(held, {"a": 1}, DEEP.zoom, nodata="drop")


def test_runs_are_read_off_one_sort_without_a_table_of_runs(make_cells):
    cells = make_cells({"a": [[1, 1, None, None], ["-", 2, 2, 1]], "b": [[0, 0, 0, 0, 0, 1]]}, DEEP)
    told = runs.cells_to_runs(cells)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == 1
    got = {(r.layer, r.gy, r.x0, r.x1, r.value) for r in told.collect()}
    assert got == {("a", 0, 0, 1, 1), ("a", 0, 2, 3, None), ("a", 1, 1, 2, 2), ("a", 1, 3, 3, 1), ("b", 0, 0, 3, 0), ("b", 0, 4, 4, 0), ("b", 0, 5, 5, 1)}


def test_cells_that_stand_twice_are_in_one_run(make_cells):
    cells = make_cells({"a": [[1, 1, 1, 1]]}, DEEP)
    told = runs.cells_to_runs(cells.unionByName(cells.filter("gx = 2")))
    assert sorted((r.x0, r.x1) for r in told.collect()) == [(0, 1), (2, 3)]
