"""Coordinates, keys, extents, resampling and pyramids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overgrid.functions import projection, zcurve
from overgrid.model import CELL_KEYS, WORLD_HALF, Grid


def reproject_points(points: DataFrame, inverse: bool = False) -> DataFrame:
    """Add ``x, y`` (web mercator) from ``lon, lat``, or with ``inverse`` the other way round."""
    if inverse:
        return points.withColumns(
            {"lon": projection.mercator_lon(F.col("x")), "lat": projection.mercator_lat(F.col("y"))}
        )
    return points.withColumns({"x": projection.mercator_x(F.col("lon")), "y": projection.mercator_y(F.col("lat"))})


def albers_project(points: DataFrame, inverse: bool = False, conic: projection.Albers | None = None) -> DataFrame:
    """Add ``x, y`` on the equal-area conic from ``lon, lat``, or with ``inverse`` the other way round."""
    conic = conic or projection.Albers()
    if inverse:
        lon, lat = conic.inverse(F.col("x"), F.col("y"))
        return points.withColumns({"lon": lon, "lat": lat})
    x, y = conic.forward(F.col("lon"), F.col("lat"))
    return points.withColumns({"x": x, "y": y})


def assign_tile_key(points: DataFrame, grid: Grid) -> DataFrame:
    """Add the pixel ``gx, gy`` and tile ``tc, tr`` of ``x, y``.

    Points off the square world and points without a number for a coordinate are dropped; see ``count_dropped``.
    """
    points = points.filter(~F.isnan("x") & ~F.isnan("y"))
    fx = (F.col("x") + WORLD_HALF) / grid.cell_size
    fy = (F.lit(WORLD_HALF) - F.col("y")) / grid.cell_size
    placed = points.withColumns({"_fx": F.floor(fx), "_fy": F.floor(fy)})
    inside = placed.filter(F.col("_fx").between(0, grid.size - 1) & F.col("_fy").between(0, grid.size - 1))
    keyed = inside.withColumns({"gx": F.col("_fx").cast("int"), "gy": F.col("_fy").cast("int")}).drop("_fx", "_fy")
    return with_tile_key(keyed.withColumn("zoom", F.lit(grid.zoom)), grid)


def count_dropped(points: DataFrame, grid: Grid, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """``(*by, points, not_numbers, off_world)``: what ``assign_tile_key`` drops."""
    x, y = F.col("x"), F.col("y")
    number = F.coalesce(~(F.isnan(x) | F.isnan(y)), F.lit(False)) & x.isNotNull() & y.isNotNull()
    px, py = F.floor((x + WORLD_HALF) / grid.cell_size), F.floor((F.lit(WORLD_HALF) - y) / grid.cell_size)
    inside = px.between(0, grid.size - 1) & py.between(0, grid.size - 1)
    return points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(~number).alias("not_numbers"), F.count_if(number & ~inside).alias("off_world")
    )


def with_tile_key(cells: DataFrame, grid: Grid) -> DataFrame:
    return cells.withColumns({"tc": grid.tile_of(F.col("gx")), "tr": grid.tile_of(F.col("gy"))})


def choose_zoom(cell_size: Column, tile: int = 256, deepest: int = 30) -> Column:
    """The zoom whose cells are nearest in size to ``cell_size`` (the coarser one of two equally near)."""
    sizes = F.array(
        *[
            F.struct(F.abs(cell_size - Grid(tile, z).cell_size).alias("off"), F.lit(z).alias("zoom"))
            for z in range(deepest + 1)
        ]
    )
    return F.array_min(sizes)["zoom"]


def within(cells: DataFrame, bounds: tuple[int, int, int, int] | None) -> DataFrame:
    """Cells of the tiles in inclusive bounds: literals, which reach the scan.

    Where the store's curve key ``z`` is at hand, the rectangle is also told as ranges of the curve, along which files
    are sorted, so that row groups and pages without such tiles are skipped.
    """
    if bounds is None:
        return cells
    c0, r0, c1, r1 = bounds
    held = cells.filter(F.col("tc").between(c0, c1) & F.col("tr").between(r0, r1))
    if "z" not in cells.columns:
        return held
    ranges = zcurve.z_ranges((max(c0, 0), max(r0, 0), c1, r1))
    return held.filter(" OR ".join(f"z BETWEEN {a}L AND {b}L" for a, b in ranges) or "false")


def z_order_key(keys: DataFrame, name: str = "z") -> DataFrame:
    return keys.withColumn(name, zcurve.z_encode("tc", "tr"))


def key_to_extent(keys: DataFrame, grid: Grid) -> DataFrame:
    """Add ``xmin, ymin, xmax, ymax`` of the tile ``tc, tr``, at the keys' own ``zoom`` if they have one."""
    side = _tile_side(keys, grid)
    return keys.withColumns(
        {
            "xmin": F.col("tc") * side - WORLD_HALF,
            "ymin": WORLD_HALF - (F.col("tr") + 1) * side,
            "xmax": (F.col("tc") + 1) * side - WORLD_HALF,
            "ymax": WORLD_HALF - F.col("tr") * side,
        }
    )


def _tile_side(keys: DataFrame, grid: Grid) -> Column:
    if "zoom" in keys.columns:
        return F.lit(2 * WORLD_HALF) / F.expr("shiftleft(1L, zoom)")
    return F.lit(grid.cell_size * grid.tile)


def extent_to_bounds(extents: DataFrame, grid: Grid, unit: str = "tile") -> DataFrame:
    """Add inclusive bounds ``c0, r0, c1, r1`` (tiles or cells); right and bottom edges are exclusive."""
    side = grid.cell_size * (grid.tile if unit == "tile" else 1)
    last = (grid.tiles if unit == "tile" else grid.size) - 1

    def clamp(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0)), F.lit(last)).cast("int")

    first = {"c0": (F.col("xmin") + WORLD_HALF) / side, "r0": (WORLD_HALF - F.col("ymax")) / side}
    final = {"c1": (F.col("xmax") + WORLD_HALF) / side, "r1": (WORLD_HALF - F.col("ymin")) / side}
    out = extents.withColumns({k: clamp(F.floor(v)) for k, v in first.items()})
    return out.withColumns(
        {k: F.greatest(F.col(k.replace("1", "0")), clamp(F.ceil(v) - 1)) for k, v in final.items()}
    )


def extent_union(extents: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return extents.groupBy(*by).agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")
    )


def rasterize_points(points: DataFrame, grid: Grid, mode: str = "presence", threshold: float | None = None) -> DataFrame:
    """Point table ``(layer, x, y, ...)`` to cells.

    ``presence``: 1 where a point falls; with ``threshold``, 1 or 0 by whether one with ``value`` of at least
    that falls there.  ``count``: how many fall there.
    """
    if mode == "count":
        value = F.count(F.lit(1))
    elif mode == "presence":
        value = F.max(F.lit(1) if threshold is None else (F.col("value") >= threshold).cast("int"))
    else:
        raise ValueError(f"mode must be 'presence' or 'count', not {mode!r}")
    return assign_tile_key(points, grid).groupBy(*CELL_KEYS).agg(value.cast("int").alias("value"))


def resample_nearest(points: DataFrame, grid: Grid, sample_id: str, source_cell: float | None = None) -> DataFrame:
    """Samples ``(layer, x, y, value, <sample_id>)`` to cells: the sample nearest to each cell's centre.

    ``source_cell`` is the side of a source's own cells, in metres, with a sample at each centre: a sample then
    reaches all grid cells whose centre its cell covers, so a source coarser than the grid leaves no hole.

    Equally near samples are decided by ``sample_id``.  The choice is an aggregate with map-side partials,
    so a cell that holds most of the samples costs one row per input task in the shuffle.
    """
    fx = (F.col("x") + WORLD_HALF) / grid.cell_size
    fy = (WORLD_HALF - F.col("y")) / grid.cell_size
    dx, dy = fx - F.col("gx") - 0.5, fy - F.col("gy") - 0.5
    keyed = assign_tile_key(points, grid)
    if source_cell is not None:
        keyed = _spread(keyed, grid, fx, fy, source_cell / grid.cell_size / 2)
    keyed = keyed.withColumn("_off", dx * dx + dy * dy)
    nearest = F.min_by("value", F.struct("_off", sample_id))
    return keyed.groupBy(*CELL_KEYS).agg(nearest.alias("value"))


def _spread(keyed: DataFrame, grid: Grid, fx: Column, fy: Column, reach: float) -> DataFrame:
    """Each sample once for every cell whose centre lies within ``reach`` cells of it on both axes, its own included."""

    def span(at: Column, own: str) -> Column:
        first = F.greatest(F.least(F.ceil(at - reach - 0.5), F.col(own)), F.lit(0))
        last = F.least(F.greatest(F.floor(at + reach - 0.5), F.col(own)), F.lit(grid.size - 1))
        return F.sequence(first.cast("int"), last.cast("int"))

    wide = keyed.withColumns({"_gx": span(fx, "gx"), "_gy": span(fy, "gy")})
    columns = wide.withColumn("gx", F.explode("_gx")).withColumn("gy", F.explode("_gy"))
    return with_tile_key(columns.drop("_gx", "_gy"), grid)


def pyramid(cells: DataFrame, grid: Grid, to_zoom: int = 0, levels_at_once: int = 10, keep_base: bool = True) -> DataFrame:
    """Coarser copies of all layers, ``grid.zoom - 1`` down to ``to_zoom``, by nearest neighbour.

    A parent takes the first of its up to four children in row order.  Followed down to the base this is the
    cell that comes first on the z-order curve among all cells under the parent, at every level at once.
    So the base is shuffled once, into blocks of ``4^levels_at_once`` cells and sorted by curve position: a
    cell stands for its parents up to the highest level at which its predecessor lies under another parent.
    The first cell of each block starts the next round, which has that many fewer rows.
    """
    base = cells.filter(F.col("zoom") == grid.zoom)
    layers = [base.select("layer", "zoom", "gx", "gy", "value")] if keep_base else []
    code = F.col("code")
    level = base.select("layer", "value", zcurve.z_encode("gx", "gy", grid.bits).alias("code"))
    zoom = grid.zoom
    while zoom > to_zoom:
        up = min(levels_at_once, zoom - to_zoom)
        blocks = level.withColumn("block", F.shiftright(code, 2 * up)).repartition("layer", "block")
        before = F.lag("code").over(Window.partitionBy("layer", "block").orderBy("code"))
        differing = F.length(F.bin(code.bitwiseXOR(before)))
        leads = F.coalesce(F.floor((differing - 1) / 2).cast("int"), F.lit(up))
        stands = blocks.select("layer", "value", "code", leads.alias("leads")).filter(F.col("leads") > 0)
        each = stands.select("layer", "value", "code", F.explode(F.sequence(F.lit(1), F.col("leads"))).alias("k"))
        parent = each.select("layer", (F.lit(zoom) - F.col("k")).alias("zoom"), "value", F.expr("shiftright(code, 2 * k)").alias("code"))
        layers.append(
            parent.select(
                "layer", "zoom", zcurve.z_decode_x("code", grid.bits).alias("gx"), zcurve.z_decode_y("code", grid.bits).alias("gy"), "value"
            )
        )
        level = blocks.groupBy("layer", "block").agg(F.min_by("value", "code").alias("value"))
        level = level.select("layer", "value", F.col("block").alias("code"))
        zoom -= up
    out = layers[0]
    for more in layers[1:]:
        out = out.unionByName(more)
    return with_tile_key(out, grid).select(*CELL_KEYS, "value")
