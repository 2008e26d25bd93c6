"""Sums, counts, ratios and scores of layers inside polygons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overgrid.functions import cellmath
from overgrid.model import Grid, place_keys
from overgrid.operators.grid import within, z_order_key
from overgrid.operators.joins import spread
from overgrid.operators.vector import WHOLE_TILE, polygon_cover, polygon_spans, polygon_sweep, swept_parts


def zone_bounds(edges: DataFrame, grid: Grid) -> tuple[int, int, int, int] | None:
    """Inclusive tile bounds ``(c0, r0, c1, r1)`` around all zones, read as one row; None without zones."""
    t, last = grid.tile, grid.tiles - 1
    row = edges.agg(
        *[F.expr(f"CAST(least(greatest(floor({f}({g}({a}, {b})) / {t}), 0), {last}) AS INT)")
          for f, g, a, b in (("min", "least", "x1", "x2"), ("min", "least", "y1", "y2"), ("max", "greatest", "x1", "x2"), ("max", "greatest", "y1", "y2"))]
    ).first()
    return None if row[0] is None else tuple(row)


def covered(cells: DataFrame, cover: DataFrame) -> DataFrame:
    """Cells of the tiles that some zone meets: what no zone asks for goes before any aggregate or shuffle."""
    tiles = cover.select("tc", "tr").distinct()
    if "z" in cells.columns:
        tiles = z_order_key(tiles)
    return cells.join(tiles, tiles.columns, "left_semi")


def zonal_parts(cells: DataFrame, edges: DataFrame, grid: Grid, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``(zone_id, layer, total, data_cells, tiles)``: sum and count of data cells inside each zone, and the
    number of the layer's tiles that the zone meets.

    Tiles wholly inside a zone are answered from one sum per tile.  In the tiles on an outline each row of cells has
    running sums and counts, and a run of covered cells is two look-ups there, at its last cell and before its first.
    So the work is runs times layers plus the cells of the met tiles once, whatever the runs' lengths.  Runs and tiles
    come out of one sweep and meet their rows in one join, keyed by place, not by zone: one huge zone is spread like
    many small ones, and a row under very many zones is a hot key that Spark splits.  The join is asked to merge:
    Spark's size check counts the edges, not the runs that come out of them, and would broadcast those at any size.
    ``bounds`` around the zones (``zone_bounds``) keep the rest of the store from being read.
    """
    parts = keyed(swept_parts(polygon_sweep(edges, grid), grid), cells)
    place = place_keys(cells, "tc", "tr")
    met = parts.filter(f"gy = {WHOLE_TILE}").select(*place).distinct()
    at_zoom = within(cells.filter(F.col("zoom") == grid.zoom), bounds).join(met, place, "left_semi")
    tiles = at_zoom.groupBy("layer", *place).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    tiles = tiles.select("layer", *place, F.lit(WHOLE_TILE).alias("gy"), "s", "n", F.lit(None).cast(PREFIX).alias("upto"))
    held = prefix_rows(at_zoom).unionByName(tiles)
    return combine_parts(run_sums(parts.hint("merge").join(held, [*place, "gy"]), grid))


def keyed(places: DataFrame, cells: DataFrame) -> DataFrame:
    """``places`` with the store's bucket column, where the store has one."""
    return z_order_key(places) if "z" in cells.columns else places


PREFIX = "array<struct<gx: int, s: bigint, n: bigint>>"


def prefix_rows(cells: DataFrame) -> DataFrame:
    """``(layer, place, gy, s, n, upto)``: for each row of cells in a tile the sum and number of its data cells, and both
    up to every cell that it has, from left to right.  An array is as long as a tile is wide at most."""
    row = ["layer", *place_keys(cells, "tc", "tr"), "gy"]
    cells = cells.select(*row, "gx", "value")
    if "z" not in row:  # a bucketed store has the rows together already
        cells = spread(cells, *row)
    line = Window.partitionBy(*row).orderBy("gx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = cells.select(*row, "gx", F.sum("value").over(line).alias("s"), F.count("value").over(line).alias("n"))
    upto = F.sort_array(F.collect_list(F.struct("gx", F.coalesce("s", F.lit(0).cast("bigint")).alias("s"), "n"))).cast(PREFIX)
    rows = running.groupBy(*row).agg(upto.alias("upto"))
    return rows.select(*row, F.expr("element_at(upto, -1).s AS s"), F.expr("element_at(upto, -1).n AS n"), "upto")


def run_sums(met: DataFrame, grid: Grid) -> DataFrame:
    """``(zone_id, layer, total, data_cells, tiles)`` of runs and whole tiles with the rows that they meet: one row each.

    The entry up to a cell is at the cell's own place in a row that has all its cells.  Otherwise it is the last one
    not beyond it.
    """

    def entry(cell: str) -> str:
        at = f"get(upto, {cell} - tc * {grid.tile})"
        return f"CASE WHEN {at}.gx = {cell} THEN {at} ELSE try_element_at(filter(upto, e -> e.gx <= {cell}), -1) END"

    looked = met.selectExpr("zone_id", "layer", "gy", "whole", "s", "n", f"{entry('b')} AS last", f"{entry('a - 1')} AS before")
    run = f"gy <> {WHOLE_TILE}"

    def sums(c: str) -> str:
        return f"CASE WHEN {run} THEN coalesce(last.{c}, 0) - coalesce(before.{c}, 0) WHEN whole THEN {c} ELSE 0 END"

    return looked.selectExpr("zone_id", "layer", f"{sums('s')} AS total", f"{sums('n')} AS data_cells", f"CASE WHEN {run} THEN 0L ELSE 1L END AS tiles")


def combine_parts(parts: DataFrame) -> DataFrame:
    """Merge partial zonal results, of parts of the data or of increments, into one row per zone and layer.

    Without data cells there is no sum.
    """
    return parts.groupBy("zone_id", "layer").agg(
        F.sum("total").alias("total"), F.sum("data_cells").alias("data_cells"), F.sum("tiles").alias("tiles")
    ).withColumn("total", F.when(F.col("data_cells") > 0, F.col("total")))


def zonal_sum(cells: DataFrame, edges: DataFrame, grid: Grid, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    return zonal_parts(cells, edges, grid, bounds).select("zone_id", "layer", "total", "data_cells")


def tile_counts(cells: DataFrame, edges: DataFrame, grid: Grid, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``(zone_id, layer, tiles)``: the layer's tiles that each zone meets, from tile keys alone."""
    cover = polygon_cover(edges, grid)
    held = covered(within(cells.filter(F.col("zoom") == grid.zoom), bounds), cover)
    keys = held.select(*place_keys(held, "layer", "tc", "tr")).distinct().select("layer", "tc", "tr")
    return cover.hint("merge").join(keys, ["tc", "tr"]).groupBy("zone_id", "layer").agg(F.count(F.lit(1)).alias("tiles"))


def zone_area(edges: DataFrame, grid: Grid) -> DataFrame:
    """Cells of the grid inside each zone: ``(zone_id, area)``, from run lengths."""
    length = F.col("b").cast("bigint") - F.col("a") + 1
    return polygon_spans(edges, grid.size).groupBy("zone_id").agg(F.sum(length).alias("area"))


def cell_count(parts: DataFrame, grid: Grid) -> DataFrame:
    """All cells, NODATA included, of the layer's tiles that the zone meets."""
    return parts.select("zone_id", "layer", (F.col("tiles") * grid.tile_cells).alias("cell_count"))


def ratio_combine(ratios: DataFrame) -> DataFrame:
    """Merge partial ratios ``(zone_id, layer, total, cell_count)`` by adding sums and counts."""
    return ratios.groupBy("zone_id", "layer").agg(
        F.sum("total").alias("total"), F.sum("cell_count").alias("cell_count")
    )


def layer_ratio(
    parts: DataFrame, grid: Grid, edges: DataFrame | None = None, denominator: str = "tile_area"
) -> DataFrame:
    """``(zone_id, layer, total, cell_count, ratio)``.

    ``tile_area`` divides by all cells of the layer's tiles that the zone meets; ``study_area`` divides by
    the cells inside the zone and needs its ``edges``.
    """
    total = F.coalesce("total", F.lit(0)).alias("total")
    if denominator == "tile_area":
        counted = parts.select("zone_id", "layer", total, (F.col("tiles") * grid.tile_cells).alias("cell_count"))
    elif denominator == "study_area":
        if edges is None:
            raise ValueError("denominator 'study_area' needs edges")
        counted = parts.join(zone_area(edges, grid), "zone_id", "left").select(
            "zone_id", "layer", total, F.col("area").alias("cell_count")
        )
    else:
        raise ValueError(f"denominator must be 'tile_area' or 'study_area', not {denominator!r}")
    return with_ratio(counted)


def with_ratio(counted: DataFrame) -> DataFrame:
    return counted.withColumn("ratio", F.col("total") / F.nullif(F.col("cell_count"), F.lit(0)))


def layer_score(ratios: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """Add ``weight`` and ``score`` = ratio x weight, kept in billionths as ``nano``."""
    weight = cellmath.weight_of(F.col("layer"), weights).cast("int")
    scored = ratios.filter(F.col("layer").isin(list(weights))).withColumn("weight", weight)
    nano = cellmath.nano(F.col("ratio") * F.col("weight"))
    return scored.withColumn("nano", nano).withColumn("score", F.col("nano") / 1e9)
