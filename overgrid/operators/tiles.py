"""Packed tiles: one row per tile with all of its cells in an array, for sinks and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overgrid.functions import zcurve
from overgrid.model import CELL_KEYS, Grid

TILE = ["layer", "zoom", "tc", "tr"]


def densify_tiles(cells: DataFrame, grid: Grid, fill: int | None = None, by: list[str] = TILE) -> DataFrame:
    """Make every cell of each tile that has one explicit, as NODATA or as ``fill``.

    Only the present cells are shuffled: in tile order, each adds the missing cells up to the next one (the
    first also those before it).  A repeated cell counts once, with its greatest value.
    """
    t, last = grid.tile, grid.tile_cells - 1
    line = f"(PARTITION BY {', '.join(by)} ORDER BY i, value)"
    fill_sql = "NULL" if fill is None else str(int(fill))
    present = cells.select(*by, grid.offset_of(F.col("gx"), F.col("gy")).alias("i"), "value")
    runs = present.selectExpr(
        *by,
        "i",
        "value",
        f"coalesce(lead(i) OVER {line} - 1, {last}) AS last_i",
        f"CASE WHEN min(i) OVER {line} = i THEN 0 ELSE i END AS first_i",
    )
    once = runs.filter("last_i >= i")
    return once.selectExpr(*by, "i", "value", "explode(sequence(first_i, last_i)) AS j").selectExpr(
        *by,
        f"tc * {t} + j % {t} AS gx",
        f"CAST(tr * {t} + (j - j % {t}) / {t} AS INT) AS gy",
        f"CASE WHEN i = j THEN value ELSE {fill_sql} END AS value",
    )


def pack_tiles(cells: DataFrame, grid: Grid, by: list[str] = TILE, value: str = "value") -> DataFrame:
    """Cells to ``(*by, z, cells ARRAY)``: always ``tile^2`` long, in row order, NULL where a cell is absent.

    A repeated cell counts once, with its greatest value.
    """
    entry = F.struct(grid.offset_of(F.col("gx"), F.col("gy")).alias("i"), F.col(value).alias("v"))
    packed = cells.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    # Each entry is zipped with the next one, so that no lambda holds the whole array: the optimizer may copy the
    # array's own expression to where it is used, and inside a lambda that would be once an entry.
    follow = "slice({0}, 2, size({0}))"
    once = f"transform(filter(zip_with(_all, {follow.format('_all')}, (e, f) -> struct(e AS e, f.i AS after)), p -> coalesce(p.after <> p.e.i, true)), p -> p.e)"
    gap = f"coalesce(f.i, {grid.tile_cells}) - e.i - 1"
    gaps = f"flatten(zip_with(_e, {follow.format('_e')}, (e, f) -> concat(array(e.v), {_nulls(gap)})))"
    filled = f"CASE WHEN size(_e) = {grid.tile_cells} THEN transform(_e, e -> e.v) ELSE {gaps} END"
    whole = packed.selectExpr(*by, f"{once} AS _e").selectExpr(*by, f"concat({_nulls('get(_e, 0).i')}, {filled}) AS cells")
    return whole.select(*by, zcurve.z_encode("tc", "tr", grid.zoom).alias("z"), "cells")


def _nulls(count: str) -> str:
    return f"array_repeat(NULL, {count})"


def unpack_tiles(tiles: DataFrame, grid: Grid) -> DataFrame:
    """Packed tiles back to cells, absent ones as NODATA."""
    # The outer explode keeps the optimizer from testing the arrays' size up front, which would make them twice.
    each = tiles.select(*TILE, F.posexplode_outer("cells").alias("_i", "value")).filter("_i IS NOT NULL")
    i = F.col("_i")
    gx = F.col("tc") * grid.tile + i % grid.tile
    gy = F.col("tr") * grid.tile + F.floor(i / grid.tile)
    return each.withColumns({"gx": gx.cast("int"), "gy": gy.cast("int")}).select(*CELL_KEYS, "value")
