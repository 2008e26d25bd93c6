"""Queries of the tile route: a table of requests, each with its own tile, zoom, layers, weights, breaks, ramp and polygon."""

from __future__ import annotations

from pyspark.sql import functions as F

from overgrid.operators import grid
from overgrid.plans import pictures
from workloads import fixtures as fx
from workloads.colors import _RAMPS
from workloads.fixtures import sql
from workloads.registry import query

# A triangle in lon/lat per request, near the map's corner, and the tile that holds a point of it; written digit by
# digit so that both engines make the same text.  Every third request has no polygon, every tenth one that is none.
_A, _B = "(req_id * 7919 % 600000)", "(req_id * 104729 % 50000)"
_CORNERS = [(_A, _B), (f"({_A} + 130000 + req_id % 7 * 10000)", f"({_B} + 3000)"), (f"({_A} + 20000)", f"({_B} + 11000 + req_id % 5 * 1000)")]
_FINE = "req_id % 4 <> 0"


def _wishes(string: str) -> str:
    def point(a: str, b: str) -> str:
        lon = f"'-179.', lpad(cast(9999999 - {a} as {string}), 7, '0')"
        lat = f"'85.', lpad(cast(511287 - {b} as {string}), 7, '0')"
        return f"'[', {lon}, ',', {lat}, ']'"

    ring = ", ',', ".join(point(a, b) for a, b in _CORNERS)
    text = f"""case when req_id % 3 = 0 then '' when req_id % 10 = 1 then 'not json'
  else concat('{{"type":"Polygon","coordinates":[[', {ring}, ']]}}') end"""
    breaks = f"""case when req_id % 4 = 1 then concat('-2,', cast(req_id % 3 as {string}), ',4') when req_id % 4 = 2 then '5,-1,x,1,3,9,20,12,15' else '' end"""
    zoom = f"case when {_FINE} then {fx.GRID.zoom} else {fx.GRID.zoom - 1} end"
    tile = [f"cast(floor(({at} + {off}) / ({size}e0 * case when {_FINE} then 1 else 2 end)) as int)" for at, off, size in ((_A, 30000, 109863), (_B, 3000, 9480))]
    return f"""select req_id, {zoom} as zoom, {tile[0]} as tc, {tile[1]} as tr, layers, weights, {breaks} as breaks, color_ramp, {text} as geojson from requests"""


def wishes(spark, sf):
    fx.requests(spark, sf).createOrReplaceTempView("requests")
    return spark.sql(_wishes("string"))


def levels(spark, sf):
    """The store with one coarser level."""
    return grid.pyramid(fx.store(spark, sf), fx.GRID, fx.GRID.zoom - 1)


_H, _R = "20037508.342789244e0", "6378137e0"
_ORACLE = f"""+wishes as ({_wishes("varchar")}),
cut as (select *, string_split(rtrim(layers, ','), ',') as l, string_split(rtrim(weights, ','), ',') as w from wishes),
pairs as (select req_id, l[i] as layer, cast(w[i] as int) as weight from (select *, unnest(range(1, 1 + least(len(l), len(w)))) as i from cut) r
  where regexp_full_match(w[i], '[+-]?[0-9]+')),
base as (select layer, zoom, gx, gy, value from cells union all select layer, zoom, gx, gy, value from mask),
lv as (select *, cast(floor(gx / 32e0) as int) as tc, cast(floor(gy / 32e0) as int) as tr from (
  select layer, zoom, gx, gy, value from base
  union all select layer, cast({fx.GRID.zoom - 1} as int), cast(floor(gx / 2e0) as int), cast(floor(gy / 2e0) as int), value from (
    select *, row_number() over (partition by layer, floor(gx / 2e0), floor(gy / 2e0) order by gy % 2, gx % 2) as rn from base) c where rn = 1) u),
valid as (select req_id, zoom, tc, tr, geojson = '' as free, geojson from wishes where geojson = '' or json_valid(geojson)),
sums as (select v.req_id, c.zoom, c.tc, c.tr, c.gx, c.gy, case when count(value) < count(*) then null else cast(sum(value * weight) as bigint) end as total
  from lv c join valid v on v.zoom = c.zoom and v.tc = c.tc and v.tr = c.tr join pairs p on p.req_id = v.req_id and p.layer = c.layer
  where c.layer <> 'mask' group by all),
verts as (select req_id, i as pos, ({_R} * radians(lon) + {_H}) / (2e0 * {_H}) * side as x, ({_H} - {_R} * ln(tan(pi() / 4 + radians(lat) / 2))) / (2e0 * {_H}) * side as y
  from (select req_id, i, 32e0 * pow(2, zoom) as side, cast(json_extract(geojson, '$.coordinates[0][' || i || '][0]') as double) as lon,
    cast(json_extract(geojson, '$.coordinates[0][' || i || '][1]') as double) as lat from (select * from valid where not free) f cross join (values (0), (1), (2)) as k(i)) p),
sides as (select p.req_id, p.x as x1, p.y as y1, q.x as x2, q.y as y2 from verts p join verts q on p.req_id = q.req_id and q.pos = (p.pos + 1) % 3),
within_ as (select s.req_id, s.gx, s.gy from sums s join sides e on e.req_id = s.req_id and (e.y1 > s.gy + 0.5e0) <> (e.y2 > s.gy + 0.5e0)
  and s.gx + 0.5e0 < (e.x2 - e.x1) * (s.gy + 0.5e0 - e.y1) / (e.y2 - e.y1) + e.x1 group by all having count(*) % 2 = 1),
seen as (select s.*, case when m.value is not null and total <> 0 and (free or i.gx is not null) then total end as value
  from sums s join valid v using (req_id) join (select distinct zoom, tc, tr from lv where layer = 'mask') t on t.zoom = s.zoom and t.tc = s.tc and t.tr = s.tr
  left join (select * from lv where layer = 'mask') m on m.zoom = s.zoom and m.gx = s.gx and m.gy = s.gy
  left join within_ i on i.req_id = s.req_id and i.gx = s.gx and i.gy = s.gy),
listed as (select req_id, color_ramp, [b for b in string_split(breaks, ',') if regexp_full_match(b, '[+-]?[0-9]+')] as bs from wishes),
styles as (select req_id, cast(len(bs) as int) as num_breaks, color_ramp from listed),
""" + _RAMPS.lstrip("+").replace("from requests)", "from styles)") + """,legend as (select c.req_id, c.rgba, cast(bs[k] as bigint) as brk from colored c join listed using (req_id)),
painted as (select s.req_id, s.zoom, s.tc, s.tr, s.gx, s.gy, s.value, cast(coalesce(min_by(rgba, brk), 0) as bigint) as rgba
  from seen s left join legend l on l.req_id = s.req_id and s.value <= l.brk group by all)
"""


@query("request_tiles", sql(_ORACLE + "select * from painted", "requests", "cells", "mask"))
def request_tiles(spark, sf):
    """Every request's colored cells, requests at two zooms mixed."""
    return pictures.request_tiles(levels(spark, sf), wishes(spark, sf), fx.GRID)


@query(
    "request_images",
    sql(
        _ORACLE
        + """select w.req_id, w.zoom, w.tc, w.tr, case when v.req_id is null then 'no polygon' when n is null then 'no tile' else 'picture' end as status,
  case when n is not null then cast(1024 as bigint) end as n, checksum
from wishes w left join valid v using (req_id) left join (select req_id, count(*) as n,
  cast(sum(((gy % 32) * 32 + gx % 32 + 1) * rgba) as bigint) as checksum from painted group by req_id) p using (req_id)""",
        "requests",
        "cells",
        "mask",
    ),
)
def request_images(spark, sf):
    """One picture or one reason a request; pictures shown by length and a checksum over positions."""
    images = pictures.request_images(levels(spark, sf), wishes(spark, sf), fx.GRID)
    term = "aggregate(transform(pixels, (v, i) -> (i + 1) * v), 0L, (s, t) -> s + t)"
    return images.select(*pictures.WISH, "status", F.size("pixels").cast("bigint").alias("n"), F.expr(term).alias("checksum")).withColumn(
        "n", F.when(F.col("status") == pictures.PICTURE, F.col("n"))
    )
