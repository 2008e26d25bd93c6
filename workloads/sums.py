"""Queries over tables of requests, from text to score."""

from __future__ import annotations

from overgrid.plans import sums
from workloads import fixtures as fx
from workloads.fixtures import CTES, sql
from workloads.registry import query
from workloads.zones import _PARTS

# One triangle in lon/lat per supplier near the map's corner, written digit by digit so that both engines make the
# same text; every tenth is no JSON.
_A, _B = "(s_suppkey * 7919 % 1500000)", "(s_suppkey * 104729 % 120000)"
_CORNERS = [(_A, _B), (f"({_A} + 100000 + s_suppkey % 7 * 10000)", f"({_B} + 3000)"), (f"({_A} + 20000)", f"({_B} + 9000 + s_suppkey % 5 * 1000)")]


def _texts(string: str) -> str:
    def point(a: str, b: str) -> str:
        lon = f"'-179.', lpad(cast(9999999 - {a} as {string}), 7, '0')"
        lat = f"'85.', lpad(cast(511287 - {b} as {string}), 7, '0')"
        return f"'[', {lon}, ',', {lat}, ']'"

    ring = ", ',', ".join(point(a, b) for a, b in _CORNERS)
    layers = "case when s_suppkey % 3 = 0 then 'AF,NF,RF' when s_suppkey % 3 = 1 then 'RO,AO,' else 'NO,none,RO' end"
    weights = f"concat(cast(s_suppkey % 5 - 2 as {string}), case when s_suppkey % 7 = 0 then ',x,' else ',3,' end, cast(1 + s_suppkey % 4 as {string}))"
    text = f"""case when s_suppkey % 10 = 0 then 'not json' else concat('{{"type":"Polygon","coordinates":[[', {ring}, ']]}}') end"""
    return f"select cast(s_suppkey as bigint) as req_id, {text} as geojson, {layers} as layers, {weights} as weights from supplier"


def sum_requests(spark, sf):
    fx.table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(_texts("string"))


_H, _R = "20037508.342789244e0", "6378137e0"
_VERTICES = f"""select req_id as zone_id, i as pos, ({_R} * radians(lon) + {_H}) / (2e0 * {_H}) * 1048576e0 as x,
  ({_H} - {_R} * ln(tan(pi() / 4 + radians(lat) / 2))) / (2e0 * {_H}) * 1048576e0 as y from (
  select req_id, i, cast(json_extract(j, '$.coordinates[0][' || i % 3 || '][0]') as double) as lon,
    cast(json_extract(j, '$.coordinates[0][' || i % 3 || '][1]') as double) as lat
  from (select req_id, geojson as j from ({_texts('varchar')}) t where json_valid(geojson)) v cross join (values (0), (1), (2), (3)) as k(i)) p"""

_ORACLE = sql(
    _PARTS
    + f""",asked as ({_texts('varchar')}),
cut as (select req_id, json_valid(geojson) as is_valid, string_split(rtrim(layers, ','), ',') as l, string_split(rtrim(weights, ','), ',') as w from asked),
pairs as (select req_id, cast(i - 1 as int) as pos, l[i] as layer, try_cast(w[i] as int) as weight
  from (select *, unnest(range(1, 1 + least(len(l), len(w)))) as i from cut where is_valid) r),
scored as (select req_id, layer, pos, p.weight, cast(floor(total / cast(cell_count as double) * p.weight * 1e9) as bigint) as nano
  from pairs p left join (select zone_id as req_id, layer, total, cell_count from ratios) r using (req_id, layer))
select req_id, true as is_valid, layer, 0 as is_total, pos, weight, nano / 1e9 as score from scored
union all select c.req_id, c.is_valid, null, 1, null, null, case when c.is_valid then cast(coalesce(s.nano, 0) as bigint) / 1e9 end
from cut c left join (select req_id, sum(nano) as nano from scored group by req_id) s using (req_id)""",
    "cells",
    "touched",
    "inside",
    "filled",
).replace(CTES["vertices"][1], _VERTICES)


@query("request_summary", _ORACLE)
def request_summary(spark, sf):
    """GeoJSON, layers and weights of each request to scores and totals, invalid polygons included."""
    return sums.request_summary(fx.cells(spark, sf), sum_requests(spark, sf), fx.GRID)


@query(
    "request_breaks",
    sql(
        f"""+asked as (select *, cast(1 + req_id % 13 as int) as num_breaks from ({_texts('varchar')}) t),
cut as (select req_id, num_breaks, string_split(rtrim(layers, ','), ',') as l, string_split(rtrim(weights, ','), ',') as w from asked),
pairs as (select req_id, num_breaks, l[i] as layer, try_cast(w[i] as int) as weight
  from (select *, unnest(range(1, 1 + least(len(l), len(w)))) as i from cut) r),
sums as (select req_id, num_breaks, gx, gy, case when count(value) < count(*) then null else sum(value * weight) end as value
  from cells join pairs using (layer) where weight <> 0 group by req_id, num_breaks, gx, gy),
ordered as (select req_id, num_breaks, value, row_number() over (partition by req_id order by value) as rn,
  count(*) over (partition by req_id) as total from sums where value is not null)
select req_id, k, cast(min(value) as bigint) as brk from ordered, (select cast(unnest(range(1, 14)) as int) as k) ks
where k <= num_breaks and rn * num_breaks >= k * total group by req_id, k""",
        "cells",
    ),
)
def request_breaks(spark, sf):
    """Class breaks of each request's own layers, weights and number of breaks."""
    asked = sum_requests(spark, sf).selectExpr("*", "CAST(1 + req_id % 13 AS INT) AS num_breaks")
    return sums.request_breaks(fx.cells(spark, sf), asked, fx.LAYERS, fx.GRID.zoom)
