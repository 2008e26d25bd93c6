"""One picture of an overlay: a map extent on a grid of columns and rows, colored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overgrid.model import WORLD_HALF, Grid
from overgrid.operators.color import classify
from overgrid.operators.vector import mask_by_polygon
from overgrid.plans.overlay import weighted_overlay


def tile_bounds(extent: tuple[float, float, float, float], grid: Grid) -> tuple[int, int, int, int]:
    side, last = grid.cell_size * grid.tile, grid.tiles - 1

    def clamp(v: float) -> int:
        return max(0, min(last, int(v // 1)))

    xmin, ymin, xmax, ymax = extent
    return (
        clamp((xmin + WORLD_HALF) / side),
        clamp((WORLD_HALF - ymax) / side),
        clamp((xmax + WORLD_HALF) / side),
        clamp((WORLD_HALF - ymin) / side),
    )


def wms_overlay(
    cells: DataFrame,
    weights: Mapping[str, int],
    grid: Grid,
    extent: tuple[float, float, float, float],
    cols: int,
    rows: int,
    breaks: Sequence[int],
    colors: Sequence[int],
    edges: DataFrame | None = None,
) -> DataFrame:
    """The overlay over ``extent`` (web mercator) resampled to ``cols`` x ``rows`` picture cells.

    Rows ``(col, row, value, rgba)``, with ``edges`` also ``zone_id`` and one picture a zone: each picture cell takes the overlay cell under its centre.  Several
    picture cells may show one overlay cell, so every overlay cell tells which centres it lies under.
    """
    over = weighted_overlay(cells, weights, grid, bounds=tile_bounds(extent, grid))
    if edges is not None:
        over = mask_by_polygon(over, edges, grid)
    xmin, ymin, xmax, ymax = extent
    # picture coordinates of the cell's left and top edges: a + b * g
    per_col = grid.cell_size * cols / (xmax - xmin)
    per_row = grid.cell_size * rows / (ymax - ymin)
    col_at = (-WORLD_HALF - xmin) * cols / (xmax - xmin)
    row_at = (ymax - WORLD_HALF) * rows / (ymax - ymin)

    def centres(g: str, at: float, per: float, count: int):
        first = F.ceil(F.col(g) * per + at - 0.5)
        last = F.ceil((F.col(g) + 1) * per + at - 0.5) - 1
        return F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(count - 1)).cast("int")

    c0, c1 = centres("gx", col_at, per_col, cols)
    r0, r1 = centres("gy", row_at, per_row, rows)
    hit = over.withColumns({"_c0": c0, "_c1": c1, "_r0": r0, "_r1": r1}).filter("_c0 <= _c1 AND _r0 <= _r1")
    shown = hit.withColumn("col", F.explode(F.sequence("_c0", "_c1"))).withColumn("row", F.explode(F.sequence("_r0", "_r1")))
    zone = [] if edges is None else ["zone_id"]
    return shown.select(*zone, "col", "row", "value", classify(F.col("value"), breaks, colors).alias("rgba"))
