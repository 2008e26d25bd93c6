"""The tile route as a table of requests: each asks one tile at its own zoom, in its own layers, weights and colors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overgrid.functions import cellmath
from overgrid.model import CELL_KEYS, WORLD_HALF, Grid
from overgrid.operators import color
from overgrid.operators.grid import with_tile_key
from overgrid.operators.requests import weighed_layers
from overgrid.operators.tiles import pack_tiles
from overgrid.operators.vector import map_rings, parse_geojson, reproject_polygon
from overgrid.plans.overlay import MASK
from overgrid.sources.store import in_world

WISH = ["req_id", "zoom", "tc", "tr"]
STYLE = ("breaks", "color_ramp")
PICTURE, NO_TILE, NO_POLYGON = "picture", "no tile", "no polygon"


def request_tiles(cells: DataFrame, requests: DataFrame, grid: Grid, ramps: DataFrame | None = None, mask_layer: str = MASK) -> DataFrame:
    """``(req_id, zoom, tc, tr, gx, gy, value, rgba)``: the colored cells of each asked tile.

    ``requests`` is ``(req_id, zoom, tc, tr, layers, weights, breaks, color_ramp, geojson)``: comma lists, a ramp's
    name (unknown or null: the default) and a polygon in lon/lat (null or empty: none).  ``req_id`` is unique.  Of
    ``grid`` only the tile side counts.  A cell's value is the sum of its weighed layers, zero weights included; a sum
    of zero is NODATA, and so is what the mask layer or the polygon leaves out.  A tile that the mask lacks, and a
    request whose text is no polygon, give no cells.  Entries that are no number are left out of weights and breaks.

    Requests for one tile in the same weights are one job, named by its smallest request, so a tile is read and added
    once for all who ask it, and the cells meet the requests only to be colored.  The jobs tell the scan their layers,
    zooms and tiles.  After that join a job's cells are moved once: it is a tile, so it is of bounded size.
    """
    shown, asked = _asked_jobs(cells, _wished(requests, grid), requests, ramps, mask_layer)
    out = shown.join(asked, "job")
    crossed = F.get("crossings", F.col("gy") - F.col("tr") * grid.tile)
    inside = F.col("crossings").isNull() | (F.size(F.filter(crossed, lambda x: F.col("gx") + 0.5 < x)) % 2 == 1)
    # Cells without data, most of them, are told apart before the look-ups, which cost far more.
    out = out.select(*WISH, "gx", "gy", F.when(F.col("value").isNotNull() & inside, F.col("value")).alias("value"), "legend")
    hit = F.when(F.col("value").isNotNull(), F.get(F.filter("legend", lambda e: F.col("value") <= e["brk"]), F.lit(0))["rgba"])
    return out.select(*WISH, "gx", "gy", "value", F.coalesce(hit, F.lit(color.TRANSPARENT)).cast("bigint").alias("rgba"))


def request_images(cells: DataFrame, requests: DataFrame, grid: Grid, ramps: DataFrame | None = None, mask_layer: str = MASK) -> DataFrame:
    """One row for every request: ``(req_id, zoom, tc, tr, status, pixels)``.

    ``pixels`` are the tile's RGBA numbers in row order, transparent where nothing is shown.  They are NULL, and the
    status says why, where the mask or all layers lack the tile or the polygon's text is none.

    A job's tile is packed once; a request clips and colors the packed values inside its own row, so no cell is moved
    or sorted for a request.  Requests of one ``req_id`` and tile are drawn over each other, the greatest number counts.
    """
    wished = _wished(requests, grid)
    shown, asked = _asked_jobs(cells, wished, requests, ramps, mask_layer)
    packed = pack_tiles(with_tile_key(shown, grid), grid, ["job", "tc", "tr"]).select("job", "cells")
    t = grid.tile
    inside = f"crossings IS NULL OR size(filter(get(crossings, i div {t}), x -> tc * {t} + i % {t} + 0.5D < x)) % 2 = 1"
    hit = f"coalesce(get(filter(legend, e -> v <= e.brk), 0).rgba, {color.TRANSPARENT}L)"
    inked = f"transform(cells, (v, i) -> CASE WHEN v IS NOT NULL AND ({inside}) THEN {hit} ELSE {color.TRANSPARENT}L END) AS pixels"
    drawn = asked.join(packed, "job").selectExpr(*WISH, inked).repartition("req_id")
    pixels = drawn.groupBy(*WISH).agg(F.collect_list("pixels").alias("_all")).selectExpr(
        "req_id", "aggregate(slice(_all, 2, size(_all)), get(_all, 0), (a, b) -> zip_with(a, b, (x, y) -> greatest(x, y))) AS pixels"
    )
    told = wished.select(*WISH, "is_valid").join(pixels, "req_id", "left")
    status = F.when(~F.col("is_valid"), NO_POLYGON).when(F.col("pixels").isNull(), NO_TILE).otherwise(PICTURE)
    return told.select(*WISH, status.alias("status"), "pixels")


def _asked_jobs(
    cells: DataFrame, wished: DataFrame, requests: DataFrame, ramps: DataFrame | None, mask_layer: str
) -> tuple[DataFrame, DataFrame]:
    """The cells of every job, and the requests that ask them, each with its crossings and its legend."""
    drawn = wished.filter("is_valid")
    by_job = ["zoom", "tc", "tr", "recipe"]
    jobs = in_world(drawn).groupBy(*by_job).agg(F.min("req_id").alias("job"))
    asked = drawn.join(jobs, by_job).join(_legends(requests, ramps), list(STYLE), "left")
    return _job_cells(cells, jobs, mask_layer), asked.select(*WISH, "job", "crossings", "legend")


def _wished(requests: DataFrame, grid: Grid) -> DataFrame:
    """Each request with its ``recipe`` (sorted layers and weights), whether its polygon is one, and for each row of
    the tile where the polygon's edges cross it; all of it is made inside the request's row.  That is much work for few
    bytes, so requests are dealt out first: their file alone would be one task."""
    named = requests.repartition("req_id").select(
        F.coalesce("req_id", F.raise_error(F.lit("a request has no id"))).alias("req_id"), "zoom", "tc", "tr",
        weighed_layers().alias("recipe"), *[F.coalesce(c, F.lit("")).alias(c) for c in STYLE], F.nullif("geojson", F.lit("")).alias("geojson"),
    )
    # Behind a generator a polygon is parsed once, and a filter on the outcome cannot be pushed below the dealing out.
    parsed = F.inline_outer(F.array(F.struct("rings", "is_valid")))
    placed = reproject_polygon(parse_geojson(named).select(*named.columns, parsed))
    size = F.lit(grid.tile) * F.expr("shiftleft(1L, zoom)") / (2 * WORLD_HALF)
    rings = map_rings(F.col("rings"), lambda x: (x + WORLD_HALF) * size, lambda y: (F.lit(WORLD_HALF) - y) * size)
    t = grid.tile
    turned = "concat(slice(ring, 2, greatest(size(ring) - 1, 0)), slice(ring, 1, 1))"
    edges = f"flatten(transform(rings, ring -> zip_with(ring, {turned}, (p, q) -> named_struct('x1', p.x, 'y1', p.y, 'x2', q.x, 'y2', q.y))))"
    near = f"filter({edges}, e -> greatest(e.y1, e.y2) >= tr * {t} AND least(e.y1, e.y2) <= tr * {t} + {t})"
    centre = f"(tr * {t} + j + 0.5e0)"
    met = f"filter(edges, e -> (e.y1 > {centre}) <> (e.y2 > {centre}))"
    crossings = f"CASE WHEN edges IS NOT NULL THEN transform(sequence(0, {t - 1}), j -> transform({met}, e -> (e.x2 - e.x1) * ({centre} - e.y1) / (e.y2 - e.y1) + e.x1)) END"
    kept = [*WISH, "recipe", *STYLE, "geojson IS NULL OR is_valid AS is_valid"]
    shaped = placed.withColumn("rings", rings).selectExpr(*kept, f"{near} AS edges")
    return shaped.selectExpr(*[*kept[:-1], "is_valid"], f"{crossings} AS crossings")


def _job_cells(cells: DataFrame, jobs: DataFrame, mask_layer: str) -> DataFrame:
    """``(job, gx, gy, value)``: the masked sum of every job."""
    entries = F.concat(
        F.transform("recipe", lambda e: F.struct(e["layer"].alias("layer"), e["weight"].alias("weight"), F.lit(False).alias("is_mask"))),
        F.array(F.struct(F.lit(mask_layer).alias("layer"), F.lit(None).cast("int").alias("weight"), F.lit(True).alias("is_mask"))),
    )
    index = jobs.select("job", "zoom", "tc", "tr", F.inline(entries))
    value = cellmath.as_type(F.col("value"), "smallint").cast("bigint")
    met = cells.select(*CELL_KEYS, "value").join(index, ["layer", "zoom", "tc", "tr"])
    rows = met.select("job", "gx", "gy", "is_mask", value.alias("value"), "weight").repartition("job")
    is_mask: Column = F.col("is_mask")
    sums = rows.groupBy("job", "gx", "gy").agg(
        F.count(F.when(is_mask, 1)).alias("mask_cells"),
        F.count(F.when(is_mask, F.col("value"))).alias("mask_data"),
        F.count(F.when(~is_mask, 1)).alias("layer_cells"),
        cellmath.add_values(F.col("value") * F.col("weight"), F.when(~is_mask, 1)).alias("total"),
    )
    held = sums.selectExpr("*", "max(mask_cells) OVER (PARTITION BY job) AS tile_mask").filter("layer_cells > 0 AND tile_mask > 0")
    return held.select("job", "gx", "gy", cellmath.zero_as_nodata(F.when(F.col("mask_data") > 0, F.col("total"))).alias("value"))


def _legends(requests: DataFrame, ramps: DataFrame | None) -> DataFrame:
    """The legend of each distinct pair of breaks and ramp, ordered by break; of equal breaks the last one counts."""
    styles = requests.select(*[F.coalesce(c, F.lit("")).alias(c) for c in STYLE]).distinct()
    numbers = F.filter(F.transform(F.split("breaks", ","), lambda b: F.when(b.rlike(r"^[+-]?[0-9]+$"), b).try_cast("bigint")), lambda b: b.isNotNull())
    styles = styles.withColumn("_brks", numbers).withColumn("num_breaks", F.size("_brks"))
    known = color.color_ramps(requests.sparkSession) if ramps is None else ramps
    colors = color.interpolate_ramp(color.ramp_lookup(styles, known), known)
    entry = F.struct(F.get("_brks", F.col("k") - 1).alias("brk"), (-F.col("k")).alias("last"), "rgba")
    return colors.groupBy(*STYLE).agg(F.array_sort(F.collect_list(entry)).alias("legend"))
