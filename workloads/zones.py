"""Queries of the polygon and zonal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from overgrid.operators import vector, zonal
from overgrid.plans import summary
from workloads import fixtures as fx
from workloads.fixtures import sql
from workloads.registry import query

_RINGS = """+texts as (select geom_id, json_valid(geojson) as ok, case when json_valid(geojson) then geojson end as j from geojson),
shapes as (select geom_id, ok, coalesce(json_extract(j, '$.geometry.coordinates'), json_extract(j, '$.coordinates')) as c from texts),
ring0 as (select geom_id, ok, i, cast(json_extract(c, '$[0][' || i || '][0]') as double) as lon,
  cast(json_extract(c, '$[0][' || i || '][1]') as double) as lat from shapes cross join (values (0), (1), (2)) as v(i))
"""


def _vertices(zones):
    ring = zones.select("geom_id", "is_valid", F.posexplode_outer(F.get("rings", F.lit(0))).alias("i", "p"))
    return ring.select("geom_id", "is_valid", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query(
    "parse_geojson",
    sql(
        _RINGS
        + "select geom_id, ok as is_valid, case when ok then i end as i, lon as x, lat as y from ring0 where ok or i = 0",
        "geojson",
    ),
)
def parse_geojson(spark, sf):
    return _vertices(vector.parse_geojson(fx.geojson(spark, sf)))


@query(
    "reproject_polygon",
    sql(
        _RINGS
        + """select geom_id, i, round(6378137e0 * radians(lon), 3) as x, round(6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) as y
from ring0 where ok""",
        "geojson",
    ),
)
def reproject_polygon(spark, sf):
    valid = vector.parse_geojson(fx.geojson(spark, sf)).filter("is_valid")
    rows = _vertices(vector.reproject_polygon(valid))
    return rows.select("geom_id", "i", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("polygon_edges", sql("select * from edges", "edges"))
def polygon_edges(spark, sf):
    return fx.edges(spark, sf)


@query("polygon_to_cells", sql("select * from filled", "filled"))
def polygon_to_cells(spark, sf):
    return vector.polygon_to_cells(fx.edges(spark, sf), fx.GRID)


@query("polygon_touched_tiles", sql("select * from touched", "touched"))
def polygon_touched_tiles(spark, sf):
    return vector.polygon_touched_tiles(fx.edges(spark, sf), fx.GRID)


@query(
    "mask_by_polygon",
    sql(
        """select t.zone_id, c.layer, c.zoom, c.tc, c.tr, c.gx, c.gy, case when i.gx is not null then c.value end as value
from cells c join touched t using (tc, tr) left join inside i on i.zone_id = t.zone_id and i.gx = c.gx and i.gy = c.gy""",
        "cells",
        "touched",
        "inside",
    ),
)
def mask_by_polygon(spark, sf):
    masked = vector.mask_by_polygon(fx.cells(spark, sf), fx.edges(spark, sf), fx.GRID)
    return masked.select("zone_id", "layer", "zoom", "tc", "tr", "gx", "gy", "value")


_PARTS = """+held as (select distinct layer, tc, tr from cells),
tiles as (select zone_id, layer, count(*) as tiles from touched join held using (tc, tr) group by 1, 2),
sums as (select zone_id, layer, cast(sum(value) as bigint) as total, count(value) as data_cells from inside join cells using (gx, gy) group by 1, 2),
area as (select zone_id, count(*) as area from filled group by 1),
parts as (select zone_id, layer, total, coalesce(data_cells, 0) as data_cells, tiles from tiles left join sums using (zone_id, layer)),
ratios as (select zone_id, layer, coalesce(total, 0) as total, tiles * 1024 as cell_count from parts)
"""
_NEEDS = ("cells", "touched", "inside", "filled", "weights")


def _parts(spark, sf):
    return zonal.zonal_parts(fx.cells(spark, sf), fx.edges(spark, sf), fx.GRID)


@query("zonal_sum", sql(_PARTS + "select zone_id, layer, total, data_cells from parts", *_NEEDS))
def zonal_sum(spark, sf):
    return zonal.zonal_sum(fx.cells(spark, sf), fx.edges(spark, sf), fx.GRID)


@query("cell_count", sql(_PARTS + "select zone_id, layer, cell_count from ratios", *_NEEDS))
def cell_count(spark, sf):
    return zonal.cell_count(zonal.tile_counts(fx.cells(spark, sf), fx.edges(spark, sf), fx.GRID), fx.GRID)


@query("layer_ratio", sql(_PARTS + "select *, total / cast(cell_count as double) as ratio from ratios", *_NEEDS))
def layer_ratio(spark, sf):
    return zonal.layer_ratio(_parts(spark, sf), fx.GRID)


@query(
    "layer_ratio_study_area",
    sql(
        _PARTS
        + """select zone_id, layer, coalesce(total, 0) as total, area as cell_count, coalesce(total, 0) / cast(area as double) as ratio
from parts left join area using (zone_id)""",
        *_NEEDS,
    ),
)
def layer_ratio_study_area(spark, sf):
    return zonal.layer_ratio(_parts(spark, sf), fx.GRID, fx.edges(spark, sf), "study_area")


@query(
    "ratio_combine",
    sql(
        _PARTS
        + """select layer as zone_id, case when zone_id % 2 = 0 then 'even' else 'odd' end as layer,
  cast(sum(total) as bigint) as total, cast(sum(cell_count) as bigint) as cell_count from ratios group by 1, 2""",
        *_NEEDS,
    ),
)
def ratio_combine(spark, sf):
    """Partial ratios of all zones merged into one per layer and group of zones."""
    ratios = zonal.layer_ratio(_parts(spark, sf), fx.GRID)
    group = F.when(F.col("zone_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))
    return zonal.ratio_combine(ratios.select(F.col("layer").alias("zone_id"), group.alias("layer"), "total", "cell_count"))


@query(
    "layer_score",
    sql(
        _PARTS
        + """select zone_id, layer, weight, cast(floor(total / cast(cell_count as double) * weight * 1e9) as bigint) as nano
from ratios join weights using (layer)""",
        *_NEEDS,
    ),
)
def layer_score(spark, sf):
    return zonal.layer_score(zonal.layer_ratio(_parts(spark, sf), fx.GRID), fx.WEIGHTS).select("zone_id", "layer", "weight", "nano")


_SCORES = """zs as (select distinct zone_id from vertices),
scored as (select zone_id, layer, pos, weight, cast(floor(ratio * weight * 1e9) as bigint) as nano
  from zs cross join weights left join (select zone_id, layer, total / cast(cell_count as double) as ratio from ratios) r using (zone_id, layer)),
summary as (select zone_id, layer, pos, weight, 0 as is_total, nano from scored
  union all select zone_id, null, null, null, 1, cast(coalesce(sum(nano), 0) as bigint) from scored group by zone_id)
"""


@query(
    "zonal_summary",
    sql(_PARTS + "," + _SCORES + "select zone_id, layer, pos, weight, is_total, nano / 1e9 as score from summary", *_NEEDS),
)
def zonal_summary(spark, sf):
    return summary.zonal_summary(fx.cells(spark, sf), fx.edges(spark, sf), fx.WEIGHTS, fx.GRID)


@query(
    "zonal_summary_study_area",
    sql(
        _PARTS.replace("tiles * 1024 as cell_count from parts", "area as cell_count from parts left join area using (zone_id)")
        + ","
        + _SCORES
        + "select zone_id, layer, pos, weight, is_total, nano / 1e9 as score from summary",
        *_NEEDS,
    ),
)
def zonal_summary_study_area(spark, sf):
    return summary.zonal_summary(fx.cells(spark, sf), fx.edges(spark, sf), fx.WEIGHTS, fx.GRID, "study_area")


_DISPLAY = " ".join(f"when '{k}' then '{v}'" for k, v in fx.DISPLAY.items())


@query(
    "summary_report",
    sql(
        _PARTS
        + ","
        + _SCORES
        + f"""select zone_id, is_total, pos, weight,
  case when is_total = 1 then 'Score:' else coalesce(case layer {_DISPLAY} end, 'Layer:') end as label,
  sign(nano) * ((abs(nano) + 50000) // 100000) / 100e0 as percent from summary""",
        *_NEEDS,
    ),
)
def summary_report(spark, sf):
    rows = ", ".join(f"('{k}', '{v}')" for k, v in fx.DISPLAY.items())
    config = spark.sql(f"SELECT * FROM VALUES {rows} AS t(layer, display)")
    totals = summary.zonal_summary(fx.cells(spark, sf), fx.edges(spark, sf), fx.WEIGHTS, fx.GRID)
    return summary.summary_report(totals, config).drop("score_text")
