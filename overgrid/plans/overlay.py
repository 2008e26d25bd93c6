"""The weighted overlay, its class breaks and its tiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overgrid.functions import cellmath
from overgrid.model import Grid, place_keys
from overgrid.operators.grid import with_tile_key, within
from overgrid.operators.stats import histogram_exact, quantile_breaks
from overgrid.operators.vector import mask_by_polygon

MASK = "mask"


def overlay_sum(cells: DataFrame, weights: Mapping[str, int], nodata: str = "propagate") -> DataFrame:
    """Weighted sum of layers, unmasked: ``(zoom, gx, gy, value)``.  One scan, one hash aggregate."""
    use = cellmath.active(weights)
    scaled = F.col("value") * cellmath.weight_of(F.col("layer"), use)
    chosen = cells.filter(F.col("layer").isin(list(use)))
    return chosen.groupBy(*place_keys(cells, "zoom", "gx", "gy")).agg(cellmath.add_values(scaled, nodata=nodata).alias("value"))


def weighted_overlay(
    cells: DataFrame,
    weights: Mapping[str, int],
    grid: Grid,
    bounds: tuple[int, int, int, int] | None = None,
    nodata: str = "propagate",
    mask_layer: str = MASK,
    dense: bool = False,
) -> DataFrame:
    """Weighted sum of layers at ``grid.zoom``, NODATA where the mask layer is or has no cell, dropped where it
    has no tile.

    The mask is one more layer of the same store, so sum and mask come out of the same aggregate; cells are kept by
    a semi join with the mask's tile keys.  ``dense`` says that every mask tile holds all of its cells, as ingest
    writes them: then a mask cell tells of the tile, and there is no join.  ``bounds`` are inclusive tile bounds,
    pushed to the scan.
    """
    return _masked_sum(_chosen(cells, weights, grid, bounds, mask_layer), weights, grid, nodata, mask_layer, dense)


def _chosen(
    cells: DataFrame,
    weights: Mapping[str, int],
    grid: Grid,
    bounds: tuple[int, int, int, int] | None,
    mask_layer: str,
) -> DataFrame:
    use = cellmath.active(weights)
    if mask_layer in use:
        raise ValueError(f"{mask_layer!r} is the mask and cannot be weighted as well")
    chosen = cells.filter((F.col("zoom") == grid.zoom) & F.col("layer").isin([*use, mask_layer]))
    return within(chosen, bounds)


def mask_tiles(cells: DataFrame, mask_layer: str) -> DataFrame:
    """Keys of the tiles that the mask has."""
    held = cells.filter(F.col("layer") == mask_layer)
    return held.select(*place_keys(cells, "zoom", "tc", "tr")).distinct()


def _masked_sum(
    chosen: DataFrame, weights: Mapping[str, int], grid: Grid, nodata: str, mask_layer: str, dense: bool = False
) -> DataFrame:
    """Rows with a layer cell in a tile of the mask: the weighted sum where the mask has data, else NODATA."""
    is_mask = F.col("layer") == mask_layer
    scaled = F.col("value") * cellmath.weight_of(F.col("layer"), cellmath.active(weights))
    total: Column = cellmath.add_values(scaled, F.when(~is_mask, 1), nodata)
    place = place_keys(chosen, "zoom", "gx", "gy")
    sums = chosen.groupBy(*place).agg(
        F.count(F.when(is_mask, 1)).alias("_mask_cells"),
        F.count(F.when(is_mask, F.col("value"))).alias("_mask_data"),
        F.count(F.when(~is_mask, 1)).alias("_layer_cells"),
        total.alias("_sum"),
    )
    kept = sums.filter(F.col("_layer_cells") > 0)
    value = F.when(F.col("_mask_data") > 0, F.col("_sum")).alias("value")
    if dense:
        kept = with_tile_key(kept.filter(F.col("_mask_cells") > 0).select(*place, value), grid)
    else:
        tiles = mask_tiles(chosen, mask_layer)
        kept = with_tile_key(kept.select(*place, value), grid).join(tiles, tiles.columns, "left_semi")
    return kept.select("zoom", "tc", "tr", "gx", "gy", "value")


def weighted_breaks(cells: DataFrame, weights: Mapping[str, int], num_breaks: int, zoom: int) -> DataFrame:
    """Quantile breaks ``(k, brk)`` of the unmasked overlay at the base zoom, zeros included."""
    typed = cells.filter(F.col("zoom") == zoom).withColumn("value", cellmath.as_type(F.col("value"), "smallint"))
    return quantile_breaks(histogram_exact(overlay_sum(typed, weights)), num_breaks)


def overlay_tiles(
    cells: DataFrame,
    weights: Mapping[str, int],
    grid: Grid,
    keys: DataFrame | None = None,
    edges: DataFrame | None = None,
    mask_layer: str = MASK,
    dense: bool = False,
    bounds: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Overlay for a table of tile keys ``(tc, tr)`` at ``grid.zoom``: zero sums are NODATA, masked by the mask
    layer, and per zone by polygon where ``edges`` are given.  ``bounds`` around the keys reach the scan."""
    chosen = _chosen(cells, weights, grid, bounds, mask_layer)
    chosen = chosen.withColumn("value", cellmath.as_type(F.col("value"), "smallint"))
    if keys is not None:
        chosen = chosen.join(keys.select("tc", "tr"), ["tc", "tr"], "left_semi")
    tiles = _masked_sum(chosen, weights, grid, "propagate", mask_layer, dense)
    tiles = tiles.withColumn("value", cellmath.zero_as_nodata(F.col("value")))
    return tiles if edges is None else mask_by_polygon(tiles, edges, grid)
