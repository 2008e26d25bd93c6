"""The tile route as a table, and point reads of a written store."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from overgrid.model import CELLS, EARTH_RADIUS, WORLD_HALF, Grid
from overgrid.operators import color
from overgrid.plans import pictures
from overgrid.sources import store

G = Grid(tile=4, zoom=6)
REQUESTS = "req_id BIGINT, zoom INT, tc INT, tr INT, layers STRING, weights STRING, breaks STRING, color_ramp STRING, geojson STRING"


@pytest.fixture(scope="module")
def cells(spark):
    """Two layers and a mask at two zooms; layer b has no tile (1, 0), the mask none at (0, 1)."""
    rng, rows = random.Random(5), []
    for layer in ("a", "b", "mask"):
        for zoom in (5, 6):
            for gx in range(12):
                for gy in range(12):
                    tc, tr = gx // 4, gy // 4
                    if (layer, tc, tr) in (("b", 1, 0), ("mask", 0, 1)) or rng.random() < 0.1:
                        continue
                    rows.append((layer, zoom, tc, tr, gx, gy, None if rng.random() < 0.15 else rng.randrange(1, 4)))
    return spark.createDataFrame(rows, CELLS)


def lonlat(spark, zoom, points):
    """Pixel coordinates at a zoom to a GeoJSON polygon."""
    size = G.tile << zoom
    rows = [(i, x / size * 2 * WORLD_HALF - WORLD_HALF, WORLD_HALF - y / size * 2 * WORLD_HALF) for i, (x, y) in enumerate(points)]
    lon = F.degrees(F.col("x") / EARTH_RADIUS)
    lat = F.degrees(2 * F.atan(F.exp(F.col("y") / EARTH_RADIUS)) - F.lit(3.141592653589793 / 2))
    found = spark.createDataFrame(rows, "i INT, x DOUBLE, y DOUBLE").select("i", lon.alias("lon"), lat.alias("lat")).orderBy("i").collect()
    ring = ",".join(f"[{r.lon!r},{r.lat!r}]" for r in found)
    return f'{{"type":"Polygon","coordinates":[[{ring}]]}}'


def brute(rows, request, shape):
    """One request, cell by cell."""
    at = {(r.layer, r.gx, r.gy): r.value for r in rows if (r.zoom, r.tc, r.tr) == tuple(request[1:4])}
    names, numbers = request[4].split(","), request[5].split(",")
    pairs = [(n, int(w)) for n, w in zip(names, numbers) if w.lstrip("-").isdigit()]
    if not any(layer == "mask" for layer, _, _ in at):
        return {}
    out = {}
    for gx, gy in {(x, y) for layer, x, y in at if any(layer == n for n, _ in pairs)}:
        values = [(at[n, gx, gy], w) for n, w in pairs if (n, gx, gy) in at]
        total = None if any(v is None for v, _ in values) else sum(v * w for v, w in values)
        hidden = at.get(("mask", gx, gy)) is None or (shape is not None and not covers(shape, gx + 0.5, gy + 0.5))
        out[gx, gy] = None if hidden or not total else total
    return out


def covers(points, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def asked(spark):
    shape = [(0.3, 0.2), (7.7, 2.6), (3.1, 7.4)]
    return shape, [
        (1, 6, 0, 0, "a,b", "2,-1", "0,2,5", "blue-to-red", None),
        (2, 6, 0, 0, "b,a", "-1,2", "3", "no such ramp", lonlat(spark, 6, shape)),  # the same job as 1
        (3, 5, 0, 0, "a", "3", "9,3,x,6", None, lonlat(spark, 5, shape)),
        (4, 6, 1, 0, "a,b,a", "1,5,1", "", "", ""),  # b has no such tile, a counts twice
        (5, 6, 0, 1, "a", "1", "1", "", ""),  # no mask
        (6, 6, 2, 2, "a,none,b", "0,7,many", "1,1,4", "muted-terrain-qualitative", ""),
        (7, 6, 1, 1, "a", "1", "1", "", "no polygon"),
        (8, 6, 70, 1, "a", "1", "1", "", ""),  # beyond the world
        (9, 6, 2, 1, "", "", "1", "", ""),
    ]


def test_tiles_equal_brute_force(spark, cells):
    shape, rows = asked(spark)
    got = pictures.request_tiles(cells, spark.createDataFrame(rows, REQUESTS), G).collect()
    held = cells.collect()
    for row in rows:
        mine = {(r.gx, r.gy): r.value for r in got if r.req_id == row[0]}
        assert all((r.zoom, r.tc, r.tr) == row[1:4] for r in got if r.req_id == row[0])
        want = {} if row[0] == 7 else brute(held, row, shape if row[0] in (2, 3) else None)
        assert mine == want, row
    assert {r.req_id for r in got} == {1, 2, 3, 4, 6}


def test_legends(spark, cells):
    _, rows = asked(spark)
    got = pictures.request_tiles(cells, spark.createDataFrame(rows, REQUESTS), G).collect()

    def colors(ramp, n):
        known = color.color_ramps(spark)
        table = color.interpolate_ramp(spark.createDataFrame([(ramp, n)], "ramp STRING, num_breaks INT"), known)
        return [r.rgba for r in table.orderBy("k").collect()]

    plain, one, sorted_ = colors("blue-to-red", 3), colors("blue-to-red", 1), colors("blue-to-red", 3)
    for r in got:
        v = r.value
        want = 0
        if v is not None and r.req_id == 1:
            want = next((c for b, c in zip((0, 2, 5), plain) if v <= b), 0)
        elif v is not None and r.req_id == 2:
            want = one[0] if v <= 3 else 0
        elif v is not None and r.req_id == 3:  # breaks 9, 3, 6 keep their own colors
            want = next((c for b, c in sorted(zip((9, 3, 6), sorted_)) if v <= b), 0)
        assert r.rgba == want, r


def test_every_request_has_one_image_or_a_reason(spark, cells):
    _, rows = asked(spark)
    got = {r.req_id: r for r in pictures.request_images(cells, spark.createDataFrame(rows, REQUESTS), G).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "picture", 2: "picture", 3: "picture", 4: "picture", 5: "no tile", 6: "picture", 7: "no polygon", 8: "no tile", 9: "no tile"}
    assert all((len(r.pixels) == 16) if r.status == "picture" else (r.pixels is None) for r in got.values())
    empty = spark.createDataFrame([], REQUESTS)
    assert pictures.request_images(cells, empty, G).count() == 0


def test_a_job_is_read_once(spark, cells):
    """A hundred requests for one tile in the same weights are one job."""
    rows = [(i, 6, 0, 0, "a,b" if i % 2 else "b,a", "2,-1" if i % 2 else "-1,2", "1", "", "") for i in range(100)]
    wished = pictures._wished(spark.createDataFrame(rows, REQUESTS), G)
    assert wished.select("zoom", "tc", "tr", "recipe").distinct().count() == 1
    got = pictures.request_tiles(cells, spark.createDataFrame(rows, REQUESTS), G).groupBy("req_id").count().collect()
    assert len(got) == 100 and len({r["count"] for r in got}) == 1


def test_keys_prune_the_scan(spark, cells, tmp_path):
    """Partitions of other layers and zooms are not read, and only key columns where keys are asked."""
    path = str(tmp_path / "layers")
    store.write_layer(cells, path, partitions=2)
    held = store.open_store(spark, path)
    keys = spark.createDataFrame([(1, "a", 6, 0, 0), (2, "b", 6, 1, 0), (3, "a", 6, 99, 0), (4, None, 6, 0, 0)], "req_id INT, layer STRING, zoom INT, tc INT, tr INT")
    tile = store.read_tile(held, keys)
    want = cells.filter("layer = 'a' AND zoom = 6 AND tc = 0 AND tr = 0")
    assert sorted(map(tuple, tile.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "dynamicpruning" in tile._jdf.queryExecution().executedPlan().toString()
    missing = store.missing_tiles(held, keys)
    assert sorted(r.req_id for r in missing.collect()) == [2, 3, 4]
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "value" not in plan.split("FileScan parquet")[1].split("]")[0]


def test_keys_reach_a_shuffled_join_as_a_runtime_filter(spark, cells, tmp_path):
    path = str(tmp_path / "layers")
    store.write_layer(cells, path, partitions=2)
    keys = spark.createDataFrame([("a", 6, 0, 0)], "layer STRING, zoom INT, tc INT, tr INT")
    keys.write.parquet(str(tmp_path / "keys"))
    wanted = spark.read.parquet(str(tmp_path / "keys"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        tile = store.read_tile(store.open_store(spark, path), wanted)
        assert "might_contain" in tile._jdf.queryExecution().optimizedPlan().toString()
        assert tile.count() == cells.filter("layer = 'a' AND zoom = 6 AND tc = 0 AND tr = 0").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bucketed_tables_stay_where_they_are(spark, cells, tmp_path):
    store.write_buckets(cells, "picture_buckets", str(tmp_path / "buckets"), 4)
    held = store.open_buckets(spark, "picture_buckets", str(tmp_path / "buckets"), 4)
    keys = spark.createDataFrame([("a", 6, 0, 0)], "layer STRING, zoom INT, tc INT, tr INT")
    assert store.read_tile(held, keys).count() == cells.filter("layer = 'a' AND zoom = 6 AND tc = 0 AND tr = 0").count()


def test_requests_of_the_same_weights_are_scored_once(spark, make_cells, monkeypatch):
    """Requests that differ in order, blanks or number of breaks alone share a histogram; each has its own breaks."""
    from overgrid.plans import sums

    cells = make_cells({"a": [[1, 2, 3, 4]], "b": [[0, 0, 5, None]]}, Grid(tile=4, zoom=2))
    texts = [("a,b", "1,2", 2), ("b,a", "2,1", 3), ("a,b,none,", "1,2,7", 2), ("a", "3", 1), ("a,a", "1,2", 1), ("b", "x", 1), ("a", "0", 1)]
    rows = [(100 * i + j, *t) for j, t in enumerate(texts) for i in range(20)]
    asked = spark.createDataFrame([*rows, (None, "a", "1", 1)], "req_id long, layers string, weights string, num_breaks int")
    scored = []
    spied = sums.scenario_histogram

    def spy(cells, layers, scenarios, zoom):
        scored.append(scenarios.select("scenario_id").distinct().count())
        return spied(cells, layers, scenarios, zoom)

    monkeypatch.setattr(sums, "scenario_histogram", spy)
    got = {}
    for r in sums.request_breaks(cells, asked, ["a", "b"], 2).collect():
        got.setdefault(r.req_id, []).append((r.k, r.brk))
    want = {0: [(1, 2), (2, 13)], 1: [(1, 1), (2, 2), (3, 13)], 2: [(1, 2), (2, 13)], 3: [(1, 12)], 4: [(1, 12)]}
    assert {k: sorted(v) for k, v in got.items()} == {100 * i + j: want[j] for j in want for i in range(20)}
    assert scored == [3]


def test_pictures_are_drawn_inside_the_requests_row(spark, cells, monkeypatch):
    """No cell is moved for a request; pictures equal its cells, also of requests that come twice."""
    _, rows = asked(spark)
    requests = spark.createDataFrame(rows + rows[:3], REQUESTS)
    want = {}
    for r in pictures.request_tiles(cells, spark.createDataFrame(rows, REQUESTS), G).collect():
        want.setdefault(r.req_id, [0] * 16)[r.gy % 4 * 4 + r.gx % 4] = r.rgba
    monkeypatch.setattr(pictures, "request_tiles", None)
    got = pictures.request_images(cells, requests, G).collect()
    assert len(got) == len(rows) + 3 and {r.req_id for r in got if r.pixels} == set(want)
    assert all(r.pixels == want.get(r.req_id) for r in got)


def test_polygons_are_parsed_after_requests_are_dealt_out(spark, cells):
    requests = spark.createDataFrame([(1, 6, 0, 0, "a", "1", "2", "", "not json"), (2, 6, 0, 0, "a", "1", "2", "", "")], REQUESTS)
    plan = pictures.request_tiles(cells, requests, G)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if "RepartitionByExpression [req_id" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = [x for x in lines[at + 1 :]]
            end = next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :+-")) <= depth), len(below))
            assert not any("from_json" in x for x in below[:end])
    assert "RepartitionByExpression [req_id" in plan and "from_json" in plan
