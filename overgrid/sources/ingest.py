"""Ingest: named sources of points, by configuration, to a pyramid of layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overgrid.functions.projection import Albers
from overgrid.model import Grid
from overgrid.operators import grid as grid_ops
from overgrid.operators.tiles import densify_tiles
from overgrid.sources.store import storage_path, write_layer

MERCATOR, LONLAT, CONIC = "EPSG:3857", "EPSG:4326", "albers"


def read_source(spark: SparkSession, source: Mapping) -> DataFrame:
    """One source as ``(layer, sample_id, x, y, value)`` in web mercator.

    A source is ``{name, format, backend: {type, path}, crs, columns: {id, x, y, value}, options, filter}``;
    the columns are SQL expressions over the source's own columns.
    """
    path = storage_path(source["backend"]["type"], source["backend"]["path"])
    table = spark.read.format(source["format"]).options(**source.get("options", {})).load(path)
    if source.get("filter"):
        table = table.filter(source["filter"])
    cols = source["columns"]
    points = table.select(
        F.expr(cols["id"]).cast("bigint").alias("sample_id"),
        F.expr(cols["x"]).cast("double").alias("x"),
        F.expr(cols["y"]).cast("double").alias("y"),
        F.expr(cols["value"]).cast("int").alias("value"),
    )
    return to_mercator(points, source.get("crs", MERCATOR)).select(
        F.lit(source["name"]).alias("layer"), "sample_id", "x", "y", "value"
    )


def to_mercator(points: DataFrame, crs: str) -> DataFrame:
    if crs == MERCATOR:
        return points
    if crs == CONIC:
        lon, lat = Albers().inverse(F.col("x"), F.col("y"))
        rest = [c for c in points.columns if c not in ("x", "y")]
        # The generator keeps the optimizer from copying the long formulas into every later use of x and y.
        points = points.select(*rest, F.inline_outer(F.array(F.struct(lon.alias("lon"), lat.alias("lat")))))
    elif crs == LONLAT:
        points = points.withColumnsRenamed({"x": "lon", "y": "lat"})
    else:
        raise ValueError(f"unknown crs {crs!r}: use {MERCATOR}, {LONLAT} or {CONIC}")
    return grid_ops.reproject_points(points)


def ingest_layers(
    spark: SparkSession, sources: Sequence[Mapping], grid: Grid, pyramid: bool = True, to_zoom: int = 0
) -> DataFrame:
    """Read all sources, put their samples on the grid (nearest sample per cell) and add coarser zooms.

    A source may tell the side of its own cells as ``cellSize`` (metres).  Tiles are dense at every zoom: cells of a
    tile that no sample reaches are NODATA, and so are the parents of such cells.
    """
    bases = []
    for size in sorted({s.get("cellSize") for s in sources}, key=lambda x: (x is not None, x)):
        points = reduce(DataFrame.unionByName, [read_source(spark, s) for s in sources if s.get("cellSize") == size])
        bases.append(grid_ops.resample_nearest(points, grid, "sample_id", size))
    base = densify_tiles(reduce(DataFrame.unionByName, bases), grid)
    return densify_tiles(grid_ops.pyramid(base, grid, to_zoom), grid) if pyramid else base


def run_ingest(spark: SparkSession, sources: Sequence[Mapping], output: Mapping) -> None:
    """Ingest into a store as ``{backend: {type, path}, tileSize, cellSize: {width}, pyramid, partitions}`` asks.

    ``partitions`` is the number of files' worth of work; give one for every few hundred MB.
    """
    tile = int(output.get("tileSize", 256))
    width = float(output["cellSize"]["width"])
    zoom = min(range(31), key=lambda z: (abs(Grid(tile, z).cell_size - width), z))
    cells = ingest_layers(spark, sources, Grid(tile, zoom), bool(output.get("pyramid", True)))
    write_layer(cells, storage_path(output["backend"]["type"], output["backend"]["path"]), partitions=output.get("partitions"))
