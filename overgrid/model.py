"""The data model: one long table of cells on a square, zoomed, tiled grid.

``cells`` has one row per (layer, zoom, gx, gy)::

    layer STRING, zoom INT, tc INT, tr INT, gx INT, gy INT, value INT

``gx, gy`` count pixels from the top-left corner of the world at that zoom, ``tc, tr`` are the tile they
fall in.  A NULL value is NODATA; an absent row means that the layer does not cover the cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# EPSG:3857 sphere radius and half the width of its square world, in metres.
EARTH_RADIUS = 6378137.0
WORLD_HALF = 20037508.342789244

CELL_KEYS = ["layer", "zoom", "tc", "tr", "gx", "gy"]

CELLS = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("zoom", T.IntegerType()),
        T.StructField("tc", T.IntegerType()),
        T.StructField("tr", T.IntegerType()),
        T.StructField("gx", T.IntegerType()),
        T.StructField("gy", T.IntegerType()),
        T.StructField("value", T.IntegerType()),
    ]
)

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))


def place_keys(cells: DataFrame, *keys: str) -> list[str]:
    """Grouping or join keys of a place; with a store bucketed by tile, the bucket column ``z`` comes along so
    that Spark sees the rows are already together."""
    return ["z", *keys] if "z" in cells.columns else list(keys)


@dataclass(frozen=True)
class Grid:
    """A zoomed square layout: ``2^zoom`` tiles a side, ``tile`` cells a side in each tile."""

    tile: int = 256
    zoom: int = 9

    @property
    def tiles(self) -> int:
        return 1 << self.zoom

    @property
    def size(self) -> int:
        return self.tile << self.zoom

    @property
    def bits(self) -> int:
        """Bits of a pixel index."""
        return (self.size - 1).bit_length()

    @property
    def cell_size(self) -> float:
        return 2 * WORLD_HALF / self.size

    @property
    def tile_cells(self) -> int:
        return self.tile * self.tile

    def tile_of(self, pixel: Column) -> Column:
        """Tile index of a pixel index (floor division, also left of zero)."""
        if self.tile & (self.tile - 1) == 0:
            return F.shiftright(pixel, self.tile.bit_length() - 1)
        return ((pixel - F.pmod(pixel, F.lit(self.tile))) / self.tile).cast("int")

    def offset_of(self, gx: Column, gy: Column) -> Column:
        """Position of a cell inside its tile, row by row."""
        return F.pmod(gy, F.lit(self.tile)) * self.tile + F.pmod(gx, F.lit(self.tile))
