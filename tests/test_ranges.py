"""Rectangles as ranges of the curve, prefix rows, and joins that don't grow with the cluster."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from overgrid.functions import zcurve
from overgrid.model import Grid
from overgrid.operators import zonal
from overgrid.operators.joins import fan_join
from overgrid.operators.vector import polygon_edges, polygon_sweep, swept_parts
from overgrid.sources import store

G = Grid(tile=8, zoom=5)
RINGS = "zone_id long, rings array<array<struct<x: double, y: double>>>"


def test_ranges_hold_the_rectangle():
    rng = random.Random(2)
    for _ in range(200):
        (c0, c1), (r0, r1) = (sorted(rng.randrange(33) for _ in range(2)) for _ in range(2))
        most = rng.choice([1, 4, 32, 10_000])
        ranges = zcurve.z_ranges((c0, r0, c1, r1), most)
        wanted = {zcurve.z_number(c, r) for c in range(c0, c1 + 1) for r in range(r0, r1 + 1)}
        got = {z for a, b in ranges for z in range(a, b + 1)}
        assert wanted <= got and len(ranges) <= max(1, most)
        assert most < 10_000 or wanted == got
        assert all(a[1] + 1 < b[0] for a, b in zip(ranges[:-1], ranges[1:], strict=True))
    assert zcurve.z_ranges((3, 0, 2, 5)) == []


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(7)
    rows = [("a", G.zoom, x // 8, y // 8, x, y, rng.choice([None, 1, 2, 3])) for x in range(G.size) for y in range(G.size) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "layer string, zoom int, tc int, tr int, gx int, gy int, value int").cache()


def rows_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if "Scan parquet" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(plan)
    return sum(found)


def test_bounds_skip_what_lies_elsewhere_on_the_curve(spark, cells, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.page.row.count.limit", "500")
    try:
        store.write_layer(cells, str(tmp_path / "layers"), partitions=2)
    finally:
        conf.unset("parquet.page.row.count.limit")
    bounds = (12, 14, 17, 17)  # over the middle of the map, where the curve jumps
    plain = store.query_layer_bounds(cells, "a", G.zoom, bounds)
    keyed = store.query_layer_bounds(store.open_store(spark, str(tmp_path / "layers"), keyed=True), "a", G.zoom, bounds)
    assert sorted(map(tuple, keyed.drop("z").collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    whole = cells.count()
    assert rows_read(keyed) < whole / 4


def test_a_run_is_two_look_ups(spark, cells):
    """The join that answers runs gives one row for each run or tile and layer, however long the runs are."""
    rng = random.Random(3)
    rings = [(k, [[{"x": rng.uniform(0, G.size), "y": rng.uniform(0, G.size)} for _ in range(3)]]) for k in range(20)]
    edges = polygon_edges(spark.createDataFrame(rings, RINGS))
    parts = swept_parts(polygon_sweep(edges, G), G)
    layered = cells.unionByName(cells.withColumn("layer", F.lit("b")))
    held = zonal.prefix_rows(layered).select("layer", "tc", "tr", "gy", "upto")
    runs = parts.filter(f"gy <> {zonal.WHOLE_TILE}")
    assert runs.join(held, ["tc", "tr", "gy"]).count() <= 2 * runs.count()
    got = {(r.zone_id, r.layer): (r.total, r.data_cells) for r in zonal.zonal_sum(layered, edges, G).collect()}
    from overgrid.operators.vector import polygon_to_cells

    inside = polygon_to_cells(edges, G).join(layered, ["gx", "gy"]).groupBy("zone_id", "layer").agg(F.sum("value").alias("t"), F.count("value").alias("n"))
    want = {(r.zone_id, r.layer): (r.t, r.n) for r in inside.collect()}
    assert {k: v for k, v in got.items() if v[1]} == {k: v for k, v in want.items() if v[1]}


def test_zonal_plans_stay_small(spark, cells):
    edges = polygon_edges(spark.createDataFrame([(1, [[{"x": 1.0, "y": 1.0}, {"x": 90.0, "y": 5.0}, {"x": 40.0, "y": 99.0}]])], RINGS))
    plan = zonal.zonal_parts(cells, edges, G)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 12


def test_lookup_rows_do_not_grow_with_the_cluster(spark):
    facts, lookup = spark.range(1000).withColumn("k", F.lit(1)), spark.range(5).withColumnRenamed("id", "k")
    for parts in ("4", "4000"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            plan = fan_join(facts, lookup, ["k"])._jdf.queryExecution().optimizedPlan().toString()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert "Generate" not in plan
