"""Cell-by-cell (local) operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overgrid.functions import cellmath
from overgrid.model import place_keys
from overgrid.operators.joins import fan_join


def map_cells(cells: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn``, a function from column to column, to every value; it stays inside generated code."""
    return cells.withColumn("value", fn(F.col("value")))


def convert_cell_type(
    cells: DataFrame, cell_type: str = "smallint", read_nodata: int | None = None, write_nodata: int | None = None
) -> DataFrame:
    """Change the cell type.  ``read_nodata`` / ``write_nodata`` are in-band sentinels to read and write."""

    def convert(value: Column) -> Column:
        if read_nodata is not None:
            value = cellmath.from_sentinel(value, read_nodata)
        value = cellmath.as_type(value, cell_type)
        if write_nodata is not None:
            value = cellmath.to_sentinel(value, write_nodata).cast(cell_type)
        return value

    return map_cells(cells, convert)


def zero_to_nodata(cells: DataFrame) -> DataFrame:
    return map_cells(cells, cellmath.zero_as_nodata)


def multiply_scalar(cells: DataFrame, weights: Mapping[str, int] | DataFrame) -> DataFrame:
    """Multiply each layer by its weight; layers without a weight are left out.

    A mapping becomes literals (the layer filter prunes partitions); a ``(layer, weight, ...)`` table, such
    as one row per scenario and layer, is joined.
    """
    if isinstance(weights, DataFrame):
        scaled = fan_join(cells, weights, ["layer"])
        return scaled.withColumn("value", F.col("value") * F.col("weight").cast("bigint")).drop("weight")
    chosen = cells.filter(F.col("layer").isin(list(weights)))
    return map_cells(chosen, lambda v: v * cellmath.weight_of(F.col("layer"), weights))


def local_add(cells: DataFrame, by: tuple[str, ...] = (), nodata: str = "propagate") -> DataFrame:
    """Add all layers cell by cell: one hash aggregate, however many layers there are."""
    keys = [*by, *place_keys(cells, "zoom", "tc", "tr", "gx", "gy")]
    return cells.groupBy(*keys).agg(cellmath.add_values(F.col("value"), nodata=nodata).alias("value"))


def local_mask(
    cells: DataFrame,
    mask: DataFrame,
    read_mask: int | None = None,
    write_mask: int | None = None,
    dense: bool = False,
) -> DataFrame:
    """Write ``write_mask`` where the mask equals ``read_mask``; drop cells of tiles the mask does not have.

    ``dense`` says that every tile of the mask holds all of its cells, so that one join by cell is enough.
    Otherwise the tiles are looked up first and a cell missing from a present tile counts as NODATA.
    """
    tile, cell = ["zoom", "tc", "tr"], ["zoom", "tc", "tr", "gx", "gy"]
    at = mask.select(*cell, F.col("value").alias("_mask"))
    if dense:
        joined = cells.join(at, cell)
    else:
        joined = cells.join(mask.select(*tile).distinct(), tile, "left_semi").join(at, cell, "left")
    hit = F.col("_mask").eqNullSafe(F.lit(read_mask).cast("int"))
    value = F.when(hit, F.lit(write_mask).cast("bigint")).otherwise(F.col("value"))
    return joined.withColumn("value", value).drop("_mask")
