"""Headline timings: one JSON line.  Layers are ingested to a store first, then queried from it.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3, the best counts).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from overgrid.operators import color, grid, tiles  # noqa: E402
from overgrid.operators.vector import polygon_edges  # noqa: E402
from overgrid.operators.zonal import zone_bounds  # noqa: E402
from overgrid.plans import overlay, scenarios, summary  # noqa: E402
from overgrid.sources import store  # noqa: E402
from workloads import fixtures as fx  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
BREAKS, COLORS = [-5, -1, 0, 1, 3, 6], [0x0000FFFF, 0x4466CCFF, 0x8899AAFF, 0xAA9988FF, 0xCC6644FF, 0xFF0000FF]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("overgrid-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    store.tune(spark)
    base = tempfile.mkdtemp(prefix="overgrid-bench-")
    times: dict[str, float] = {}

    for attempt in range(2):  # the first one warms the JVM
        t0 = time.time()
        dense = tiles.densify_tiles(fx.cells(spark, SF_DIR), fx.GRID)
        mask = tiles.densify_tiles(fx.mask(spark, SF_DIR), fx.GRID)
        store.write_layer(dense.unionByName(mask), f"{base}/layers-{attempt}")
        times["ingest_dense_store"] = time.time() - t0
    t0 = time.time()
    fx.zones(spark, SF_DIR).write.parquet(f"{base}/zones")
    times["write_zones"] = time.time() - t0

    t0 = time.time()
    written = store.open_store(spark, f"{base}/layers-1")
    store.write_buckets(written, "bench_cells", f"{base}/buckets", int(CPUS))
    times["write_buckets"] = time.time() - t0
    layout = os.environ.get("BENCH_LAYOUT", "buckets")
    cells = store.open_buckets(spark, "bench_cells", f"{base}/buckets", int(CPUS)) if layout == "buckets" else written
    edges = polygon_edges(spark.read.parquet(f"{base}/zones"))
    one = edges.filter("zone_id = 3")
    vectors, asked = fx.scenarios(spark, SF_DIR), fx.asked_pairs(spark, SF_DIR)
    zoom = fx.GRID.zoom
    layers = cells.filter(cells.layer != "mask")

    def picture() -> DataFrame:
        over = overlay.overlay_tiles(cells, fx.WEIGHTS, fx.GRID, dense=True)
        inked = over.withColumn("value", color.classify(over.value, BREAKS, COLORS)).selectExpr("'overlay' AS layer", "*")
        return tiles.pack_tiles(inked, fx.GRID)

    queries = {
        "weighted_overlay": lambda: overlay.weighted_overlay(cells, fx.WEIGHTS, fx.GRID, dense=True),
        "weighted_breaks": lambda: overlay.weighted_breaks(layers, fx.WEIGHTS, 10, zoom),
        "overlay_tiles_packed": picture,
        "zonal_summary": lambda: summary.zonal_summary(layers, edges, fx.WEIGHTS, fx.GRID),
        "scenario_breaks": lambda: scenarios.scenario_breaks(layers, fx.LAYERS, vectors, 10, zoom),
        "scenario_overlay": lambda: scenarios.scenario_overlay(cells, fx.LAYERS, vectors, fx.GRID),
        "scenario_zonal_summary": lambda: scenarios.scenario_zonal_summary(layers, edges, vectors, asked, fx.GRID),
        "zonal_summary_one_zone": lambda: summary.zonal_summary(layers, one, fx.WEIGHTS, fx.GRID, bounds=zone_bounds(one, fx.GRID)),
        "pyramid": lambda: grid.pyramid(layers, fx.GRID),
        "layer_metadata": lambda: store.layer_metadata(cells),
    }
    wanted = sys.argv[1:]
    for name, make in queries.items():
        if wanted and name not in wanted:
            continue
        best = float("inf")
        for _ in range(RUNS):
            t0 = time.time()
            run(make())
            best = min(best, time.time() - t0)
        times[name] = best
    rows = cells.count()
    out = {
        "metric": "overlay_headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")),
        "store_cells": rows,
    }
    spark.stop()
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
