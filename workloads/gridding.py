"""Queries of coordinates, keys, extents, resampling and pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from overgrid.model import Grid
from overgrid.operators import grid
from workloads import fixtures as fx
from workloads.fixtures import sql
from workloads.registry import query

POINT_GRID = Grid(tile=256, zoom=9)
H, R = "20037508.342789244e0", "6378137e0"
CELL = ["layer", "zoom", "tc", "tr", "gx", "gy", "value"]

_FX = f"(x + {H}) / (2e0 * {H}) * 131072e0"
_FY = f"({H} - y) / (2e0 * {H}) * 131072e0"
_PLACED = f"""+placed as (select *, cast(floor({_FX}) as int) as gx, cast(floor({_FY}) as int) as gy from mercator),
keyed as (select *, 9 as zoom, cast(floor(gx / 256e0) as int) as tc, cast(floor(gy / 256e0) as int) as tr from placed)
"""


def _points(spark, sf):
    return grid.reproject_points(fx.points(spark, sf))


@query(
    "reproject_points",
    sql(
        f"""select event_id, round(x, 3) as x, round(y, 3) as y, round(degrees(x / {R}), 9) as lon_back,
  round(degrees(2e0 * atan(exp(y / {R})) - pi() / 2), 9) as lat_back from mercator""",
        "mercator",
    ),
)
def reproject_points(spark, sf):
    there = _points(spark, sf).select("event_id", "x", "y")
    back = grid.reproject_points(there, inverse=True)
    return back.selectExpr(
        "event_id", "round(x, 3) AS x", "round(y, 3) AS y", "round(lon, 9) AS lon_back", "round(lat, 9) AS lat_back"
    )


# The conic written out with its own constants, from the formulas for the ellipsoid.
_CONIC = """+k as (select 0.0066943800229e0 as e2, 6378137e0 as a),
k1 as (select *, sqrt(e2) as e, radians(29.5e0) as p1, radians(45.5e0) as p2, radians(23e0) as p0 from k),
k2 as (select *, pow(cos(p1), 2) / (1 - e2 * pow(sin(p1), 2)) as m1, pow(cos(p2), 2) / (1 - e2 * pow(sin(p2), 2)) as m2,
  (1 - e2) * (sin(p1) / (1 - e2 * pow(sin(p1), 2)) - ln((1 - e * sin(p1)) / (1 + e * sin(p1))) / (2 * e)) as q1,
  (1 - e2) * (sin(p2) / (1 - e2 * pow(sin(p2), 2)) - ln((1 - e * sin(p2)) / (1 + e * sin(p2))) / (2 * e)) as q2,
  (1 - e2) * (sin(p0) / (1 - e2 * pow(sin(p0), 2)) - ln((1 - e * sin(p0)) / (1 + e * sin(p0))) / (2 * e)) as q0 from k1),
k3 as (select *, (m1 - m2) / (q2 - q1) as n from k2),
k4 as (select *, m1 + n * q1 as c from k3),
q as (select event_id, lon, lat, k4.*, (1 - e2) * (sin(radians(lat)) / (1 - e2 * pow(sin(radians(lat)), 2))
  - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) as q from points cross join k4),
s as (select *, a * sqrt(c - n * q) / n as rho, a * sqrt(c - n * q0) / n as rho0, n * radians(lon + 96e0) as theta from q)
"""


@query(
    "albers_project",
    sql(
        _CONIC
        + """select event_id, round(rho * sin(theta), 3) as x, round(rho0 - rho * cos(theta), 3) as y,
  round(lon, 7) as lon_back, round(lat, 7) as lat_back from s""",
        "points",
    ),
)
def albers_project(spark, sf):
    there = grid.albers_project(fx.points(spark, sf)).select("event_id", "x", "y")
    back = grid.albers_project(there, inverse=True)
    return back.selectExpr(
        "event_id", "round(x, 3) AS x", "round(y, 3) AS y", "round(lon, 7) AS lon_back", "round(lat, 7) AS lat_back"
    )


@query("assign_tile_key", sql(_PLACED + "select event_id, zoom, gx, gy, tc, tr from keyed", "mercator"))
def assign_tile_key(spark, sf):
    return grid.assign_tile_key(_points(spark, sf), POINT_GRID).select("event_id", "zoom", "gx", "gy", "tc", "tr")


@query(
    "choose_zoom",
    """select c_custkey, zoom from (select c_custkey, z.i as zoom, row_number() over (partition by c_custkey
  order by abs(size - 40075016.685578488e0 / (256e0 * (1::bigint << z.i))), z.i) as rn
from (select c_custkey, abs(c_acctbal) + 0.01e0 as size from customer) c cross join (select cast(unnest(range(0, 31)) as int) as i) z) r
where rn = 1""",
)
def choose_zoom(spark, sf):
    """A cell size per customer: the size of the account."""
    sizes = fx.table(spark, sf, "customer").selectExpr("c_custkey", "abs(c_acctbal) + 0.01D AS size")
    return sizes.select("c_custkey", grid.choose_zoom(F.col("size")).alias("zoom"))


@query(
    "rasterize_points",
    sql(
        _PLACED
        + """select layer, zoom, tc, tr, gx, gy, cast(count(*) as int) as hits, 1 as present,
  cast(max(case when value >= 20 then 1 else 0 end) as int) as high from keyed group by layer, zoom, tc, tr, gx, gy""",
        "mercator",
    ),
)
def rasterize_points(spark, sf):
    points, keys = _points(spark, sf), ["layer", "zoom", "tc", "tr", "gx", "gy"]
    hits = grid.rasterize_points(points, POINT_GRID, "count").withColumnRenamed("value", "hits")
    present = grid.rasterize_points(points, POINT_GRID).withColumnRenamed("value", "present")
    high = grid.rasterize_points(points, POINT_GRID, threshold=20).withColumnRenamed("value", "high")
    return hits.join(present, keys).join(high, keys)


@query(
    "resample_nearest",
    sql(
        _PLACED
        + f"""select layer, zoom, tc, tr, gx, gy, value from (select *, row_number() over (partition by layer, gx, gy
  order by pow({_FX} - gx - 0.5e0, 2) + pow({_FY} - gy - 0.5e0, 2), event_id) as rn from keyed) r where rn = 1""",
        "mercator",
    ),
)
def resample_nearest(spark, sf):
    return grid.resample_nearest(_points(spark, sf), POINT_GRID, "event_id").select(*CELL)


# One level after the other, each from the one below.
_LEVELS = """+levels as (select layer, zoom, gx, gy, value from base
  union all select layer, cast(zoom - 1 as int), cast(floor(gx / 2e0) as int), cast(floor(gy / 2e0) as int), value
  from (select *, row_number() over (partition by layer, floor(gx / 2e0), floor(gy / 2e0) order by gy % 2, gx % 2) as rn
    from levels where zoom > 0) c where rn = 1)
"""


@query(
    "pyramid",
    sql(
        _LEVELS.replace("+", "+base as (select layer, zoom, gx, gy, value from cells),\n", 1)
        + "select layer, zoom, cast(floor(gx / 32e0) as int) as tc, cast(floor(gy / 32e0) as int) as tr, gx, gy, value from levels",
        "cells",
    ),
)
def pyramid(spark, sf):
    return grid.pyramid(fx.cells(spark, sf), fx.GRID).select(*CELL)


_Z = " + ".join(f"(((tc >> {i}) & 1) + ((tr >> {i}) & 1) * 2) * {4**i}::bigint" for i in range(15))


@query(
    "z_order_key",
    sql(f"select distinct layer, zoom, tc, tr, cast({_Z} as bigint) as z from cells", "cells"),
)
def z_order_key(spark, sf):
    return grid.z_order_key(fx.cells(spark, sf).select("layer", "zoom", "tc", "tr").distinct())


_SIDE = f"(2e0 * {H} / 32768e0)"
_EXTENT = f"""+extents as (select req_id, tc, tr, tc * {_SIDE} - {H} as xmin, {H} - (tr + 1) * {_SIDE} as ymin,
  (tc + 1) * {_SIDE} - {H} as xmax, {H} - tr * {_SIDE} as ymax from wanted)
"""


@query(
    "key_to_extent",
    sql(
        _EXTENT
        + "select req_id, tc, tr, round(xmin, 3) as xmin, round(ymin, 3) as ymin, round(xmax, 3) as xmax, round(ymax, 3) as ymax from extents",
        "wanted",
    ),
)
def key_to_extent(spark, sf):
    keys = fx.wanted_tiles(spark, sf).select("req_id", "tc", "tr")
    rounded = [f"round({c}, 3) AS {c}" for c in ("xmin", "ymin", "xmax", "ymax")]
    return grid.key_to_extent(keys, fx.GRID).selectExpr("req_id", "tc", "tr", *rounded)


_GROWN = "xmin - 37e0 as xmin, ymin + 41e0 as ymin, xmax + 43e0 as xmax, ymax - 47e0 as ymax"
_C = f"({_SIDE} / 32e0)"


@query(
    "extent_to_bounds",
    sql(
        _EXTENT
        + f""",grown as (select req_id, {_GROWN} from extents)
select req_id, cast(greatest(floor((xmin + {H}) / {_SIDE}), 0) as int) as c0, cast(floor(({H} - ymax) / {_SIDE}) as int) as r0,
  cast(ceil((xmax + {H}) / {_SIDE}) - 1 as int) as c1, cast(ceil(({H} - ymin) / {_SIDE}) - 1 as int) as r1,
  cast(greatest(floor((xmin + {H}) / {_C}), 0) as int) as gx0, cast(ceil(({H} - ymin) / {_C}) - 1 as int) as gy1 from grown""",
        "wanted",
    ),
)
def extent_to_bounds(spark, sf):
    """Extents of the wanted tiles, shifted off the tile borders; bounds in tiles and in cells."""
    extents = grid.key_to_extent(fx.wanted_tiles(spark, sf), fx.GRID).selectExpr("req_id", *_GROWN.replace("e0", "D").split(", "))
    tiles = grid.extent_to_bounds(extents, fx.GRID)
    kept = tiles.selectExpr("req_id", "c0 AS tc0", "r0 AS tr0", "c1 AS tc1", "r1 AS tr1", "xmin", "ymin", "xmax", "ymax")
    cells = grid.extent_to_bounds(kept, fx.GRID, "cell")
    return cells.selectExpr("req_id", "tc0 AS c0", "tr0 AS r0", "tc1 AS c1", "tr1 AS r1", "c0 AS gx0", "r1 AS gy1")


@query(
    "extent_union",
    sql(
        _EXTENT
        + f"""select layer, round(min(xmin), 3) as xmin, round(min(ymin), 3) as ymin, round(max(xmax), 3) as xmax, round(max(ymax), 3) as ymax
from (select layer, e.* from extents e join wanted w using (req_id)) u group by layer""",
        "wanted",
    ),
)
def extent_union(spark, sf):
    united = grid.extent_union(grid.key_to_extent(fx.wanted_tiles(spark, sf), fx.GRID), ("layer",))
    return united.selectExpr("layer", *[f"round({c}, 3) AS {c}" for c in ("xmin", "ymin", "xmax", "ymax")])
