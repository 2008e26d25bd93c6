"""What follows from a change of a store, without a second look at the rest: statistics by tile, pyramids in part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overgrid.functions import zcurve
from overgrid.model import CELL_KEYS, WORLD_HALF, Grid, place_keys
from overgrid.operators.grid import pyramid, with_tile_key

TILE_KEY = ["layer", "zoom", "tc", "tr"]
# How each figure of a tile is merged with that of further cells of the same tile.
FIGURES = {"n": F.sum, "d": F.sum, "total": F.sum, "x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}


def tile_statistics(cells: DataFrame) -> DataFrame:
    """Per ``(layer, zoom, tc, tr)``: cells ``n``, data cells ``d``, ``total`` of their values, pixel bounds."""
    told = cells.groupBy(*place_keys(cells, *TILE_KEY)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("d"),
        F.coalesce(F.sum(F.col("value").cast("bigint")), F.lit(0).cast("bigint")).alias("total"),
        F.min("gx").alias("x0"),
        F.min("gy").alias("y0"),
        F.max("gx").alias("x1"),
        F.max("gy").alias("y1"),
    )
    return told.select(*TILE_KEY, *FIGURES)


def merge_statistics(stored: DataFrame, *more: DataFrame) -> DataFrame:
    """Statistics of cells in several tables, none of which holds a cell of another: sums add, bounds widen.

    A row per tile and table is shuffled; no cell is read.
    """
    for part in more:
        stored = stored.unionByName(part)
    return stored.groupBy(*TILE_KEY).agg(*[how(c).alias(c) for c, how in FIGURES.items()])


def replace_statistics(stored: DataFrame, changed: DataFrame, recount: DataFrame) -> DataFrame:
    """Statistics after the tiles ``changed`` were rewritten or deleted: theirs are those of ``recount``."""
    keys = changed.select(*TILE_KEY).distinct()
    return stored.join(keys, TILE_KEY, "left_anti").unionByName(recount.join(keys, TILE_KEY, "left_semi"))


def layer_totals(statistics: DataFrame) -> DataFrame:
    """Per layer and zoom: ``cells``, ``data_cells`` and the sum of values, as ratios divide them."""
    return statistics.groupBy("layer", "zoom").agg(
        F.sum("n").alias("cells"), F.sum("d").alias("data_cells"), F.sum("total").alias("total")
    )


def metadata_of(statistics: DataFrame, tile: int | None = None) -> DataFrame:
    """``layer_metadata`` from statistics by tile."""
    told = statistics.groupBy("layer", "zoom").agg(
        F.min("tc").alias("c0"),
        F.min("tr").alias("r0"),
        F.max("tc").alias("c1"),
        F.max("tr").alias("r1"),
        F.min("x0").alias("gx0"),
        F.min("y0").alias("gy0"),
        F.max("x1").alias("gx1"),
        F.max("y1").alias("gy1"),
        F.count(F.lit(1)).alias("tiles"),
        F.sum("n").alias("cells"),
        F.sum("d").alias("data_cells"),
    )
    if tile is None:
        return told
    side = F.lit(2 * WORLD_HALF / tile) / F.expr("shiftleft(1L, zoom)")
    return told.withColumns(
        {
            "xmin": F.col("gx0") * side - WORLD_HALF,
            "ymin": WORLD_HALF - (F.col("gy1") + 1) * side,
            "xmax": (F.col("gx1") + 1) * side - WORLD_HALF,
            "ymax": WORLD_HALF - F.col("gy0") * side,
        }
    )


def _tile_bits(grid: Grid) -> int:
    bits = grid.tile.bit_length() - 1
    if grid.tile != 1 << bits:
        raise ValueError(f"a tile side of {grid.tile} is no power of two, so coarser tiles don't hold whole tiles")
    return bits


def _semi(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Cells of some tiles; keys are cut to the levels there are, so they prune partitions and files of a store."""
    return cells.join(keys.filter("zoom BETWEEN 0 AND 30"), TILE_KEY, "left_semi")


def rebuilt_cells(base: DataFrame, old: DataFrame, changed: DataFrame, grid: Grid, to_zoom: int = 0) -> DataFrame:
    """New cells of a pyramid at all places above tiles ``changed (layer, tc, tr)`` of the base at ``grid.zoom``.

    ``base`` holds the cells after the change, ``old`` the pyramid before it (``to_zoom`` to ``grid.zoom - 1``; rows
    of the base level are passed over).  While a coarse cell lies above a part of one tile, changed tiles alone tell it.
    Further up it lies above many tiles, see ``_above_tiles``.  So rows read follow the change, not the store.
    """
    bits = _tile_bits(grid)
    if to_zoom >= grid.zoom:
        return old.select(*CELL_KEYS, "value").filter("false")
    tiles = changed.select("layer", "tc", "tr").distinct()
    out = _semi(base, tiles.withColumn("zoom", F.lit(grid.zoom))).select(*CELL_KEYS, "value")
    inner = min(grid.zoom - to_zoom, bits)
    if inner:
        out = pyramid(out, grid, grid.zoom - inner, keep_base=False)
    if grid.zoom - to_zoom > bits:
        whole = out.filter(F.col("zoom") == grid.zoom - bits)
        source = old.filter(F.col("zoom") < grid.zoom) if inner else base.unionByName(old.filter(F.col("zoom") < grid.zoom))
        above = _above_tiles(whole, source.select(*CELL_KEYS, "value"), tiles, grid, to_zoom)
        out = out.unionByName(above) if inner else above
    return out


def _above_tiles(whole: DataFrame, source: DataFrame, tiles: DataFrame, grid: Grid, to_zoom: int) -> DataFrame:
    """New cells above more than one tile, all levels at once; ``whole`` holds one cell for each changed tile.

    Such a cell takes the first cell along the curve beneath it.  That is one of ``whole``, or it lies in a part of the
    map without a change, which ``source`` tells: the siblings, at any level, of cells above a change are the largest
    such parts, at most three for a level and changed tile.  Keys of siblings don't depend on values, so one join reads
    those of all levels and one aggregate tells all cells.
    """
    at, top = grid.zoom - _tile_bits(grid), grid.zoom - _tile_bits(grid) - to_zoom
    level = F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias("k")
    done = tiles.select("layer", "tc", "tr", level).selectExpr("layer", "k", "shiftright(tc, k) AS gx", "shiftright(tr, k) AS gy")
    done = done.distinct()
    parents = done.selectExpr("layer", "k", "shiftright(gx, 1) AS px", "shiftright(gy, 1) AS py").distinct()
    four = ", ".join(f"named_struct('gx', px * 2 + {i}, 'gy', py * 2 + {j})" for i in (0, 1) for j in (0, 1))
    siblings = parents.selectExpr("layer", f"{at} - k AS zoom", "k", f"inline(array({four}))").join(done, ["layer", "k", "gx", "gy"], "left_anti")
    keys = with_tile_key(siblings, grid).select(*CELL_KEYS).filter("zoom BETWEEN 0 AND 30")
    told = whole.unionByName(source.join(keys, CELL_KEYS, "left_semi")).withColumn("k", F.lit(at) - F.col("zoom"))
    placed = told.select("layer", "value", "k", "gx", "gy", zcurve.z_encode("shiftleft(gx, k)", "shiftleft(gy, k)", at).alias("code"))
    each = placed.select("*", F.explode(F.sequence(F.col("k") + 1, F.lit(top))).alias("up"))
    keyed = each.selectExpr("layer", f"{at} - up AS zoom", "shiftright(gx, up - k) AS gx", "shiftright(gy, up - k) AS gy", "code", "value")
    cells = keyed.groupBy("layer", "zoom", "gx", "gy").agg(F.min_by("value", "code").alias("value"))
    return with_tile_key(cells, grid).select(*CELL_KEYS, "value")


def refresh_pyramid(base: DataFrame, old: DataFrame, changed: DataFrame, grid: Grid, to_zoom: int = 0) -> DataFrame:
    """The pyramid (``to_zoom`` to ``grid.zoom - 1``) after a change: ``rebuilt_cells`` in place of those above changed
    tiles, also where nothing is left of them, and the other cells as they were."""
    bits = _tile_bits(grid)
    levels = F.explode(F.sequence(F.lit(to_zoom), F.lit(max(to_zoom, grid.zoom - 1)))).alias("zoom")
    tiles = changed.select("layer", "tc", "tr").distinct().select("layer", "tc", "tr", levels)
    up = f"({grid.zoom} - zoom)"
    above = tiles.selectExpr(
        "layer", "zoom", *[f"shiftright({t}, greatest(0, {up} - {bits})) AS _{t}" for t in ("tc", "tr")]
    ).distinct()
    coarse = old.filter((F.col("zoom") >= to_zoom) & (F.col("zoom") < grid.zoom)).select(*CELL_KEYS, "value")
    placed = coarse.withColumns(
        {f"_{t}": F.expr(f"shiftright({g}, greatest(0, {bits} - {up}))") for t, g in (("tc", "gx"), ("tr", "gy"))}
    )
    kept = placed.join(above, ["layer", "zoom", "_tc", "_tr"], "left_anti").select(*CELL_KEYS, "value")
    return kept.unionByName(rebuilt_cells(base, old, changed, grid, to_zoom))
