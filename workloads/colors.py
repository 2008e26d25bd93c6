"""Queries of ramps, legends, classification and packed tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from overgrid.model import WORLD_HALF
from overgrid.operators import color, tiles
from overgrid.plans import image, overlay, scenarios
from workloads import fixtures as fx
from workloads.fixtures import sql
from workloads.local import _OVERLAY
from workloads.registry import query
from workloads.scenarios import _SUMS

CELL = ["layer", "zoom", "tc", "tr", "gx", "gy", "value"]
_STOPS = ", ".join(
    f"('{ramp}', {i}, {int(s[:2], 16)}, {int(s[2:4], 16)}, {int(s[4:], 16)})"
    for ramp, text in color.PALETTES.items()
    for i, s in enumerate(text.split())
)
_RAMPS = f"""+ramps as (select * from (values {_STOPS}) as v(ramp, stop, r, g, b)),
sizes as (select ramp, count(*) as m from ramps group by ramp),
looked as (select req_id, num_breaks, color_ramp, case when color_ramp in (select ramp from sizes) then color_ramp else 'blue-to-red' end as ramp from requests),
slots as (select req_id, num_breaks, ramp, m, k, case when num_breaks = 1 then 0e0 else (k - 1) * (m - 1) / cast(num_breaks - 1 as double) end as place
  from looked join sizes using (ramp) cross join (select cast(unnest(range(1, 14)) as int) as k) ks where k <= num_breaks),
stepped as (select *, case when m < num_breaks then floor(place) else floor(place + 0.5e0) end as base from slots),
mixed as (select req_id, num_breaks, s.ramp, k,
  cast(floor(p.r + (n.r - p.r) * f + 0.5e0) as bigint) as r, cast(floor(p.g + (n.g - p.g) * f + 0.5e0) as bigint) as g, cast(floor(p.b + (n.b - p.b) * f + 0.5e0) as bigint) as b
  from (select *, case when m < num_breaks then place - base else 0e0 end as f from stepped) s
  join ramps p on p.ramp = s.ramp and p.stop = s.base join ramps n on n.ramp = s.ramp and n.stop = least(s.base + 1, s.m - 1)),
colored as (select req_id, num_breaks, ramp, k, r * 16777216 + g * 65536 + b * 256 + 255 as rgba from mixed)
"""


def _asked(spark, sf):
    wishes = fx.requests(spark, sf).select("req_id", "num_breaks", "color_ramp")
    return color.ramp_lookup(wishes, color.color_ramps(spark))


@query(
    "color_ramps",
    sql(
        _RAMPS
        + """select ramp as key, '{"key":"' || ramp || '","image":"img/ramps/' || ramp || '.png"}' as json, count(req_id) as asked
from sizes left join requests on color_ramp = ramp group by ramp""",
        "requests",
    ),
)
def color_ramps(spark, sf):
    """The list of ramps, with how often each is asked for."""
    asked = fx.requests(spark, sf).groupBy(F.col("color_ramp").alias("key")).agg(F.count("*").alias("asked"))
    listed = color.color_list(color.color_ramps(spark)).join(asked, "key", "left")
    return listed.select("key", "json", F.coalesce("asked", F.lit(0)).alias("asked"))


@query("ramp_lookup", sql(_RAMPS + "select req_id, color_ramp, ramp from looked", "requests"))
def ramp_lookup(spark, sf):
    return _asked(spark, sf).select("req_id", "color_ramp", "ramp")


@query("interpolate_ramp", sql(_RAMPS + "select * from colored", "requests"))
def interpolate_ramp(spark, sf):
    return color.interpolate_ramp(_asked(spark, sf), color.color_ramps(spark)).select("req_id", "num_breaks", "ramp", "k", "rgba")


# One legend per scenario: ten breaks of its overlay and ten colors of the ramp it wishes.
_LEGEND = (
    _RAMPS.replace("from requests)", "from wishes)").replace(
        "+ramps as",
        "+wishes as (select n_nationkey as req_id, 10 as num_breaks, case n_nationkey % 5 "
        + " ".join(f"when {i} then '{r}'" for i, r in enumerate(fx.RAMP_WISHES))
        + " end as color_ramp from nation),\nramps as",
        1,
    )
    + f""",sums as ({_SUMS}),
ordered as (select scenario_id, value, row_number() over (partition by scenario_id order by value) as rn,
  count(*) over (partition by scenario_id) as total from sums where value is not null),
brks as (select scenario_id, k, min(value) as brk from ordered, (select cast(unnest(range(1, 11)) as int) as k) ks
  where rn * 10 >= k * total group by scenario_id, k),
legend as (select scenario_id, b.k, brk, rgba from brks b join colored c on c.req_id = b.scenario_id and c.k = b.k)
"""
)


def _legend(spark, sf):
    vectors = fx.scenarios(spark, sf)
    breaks = scenarios.scenario_breaks(fx.cells(spark, sf), fx.LAYERS, vectors, 10, fx.GRID.zoom)
    wishes = F.array(*[F.lit(r) for r in fx.RAMP_WISHES])
    asked = fx.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("scenario_id"), F.lit(10).alias("num_breaks"), F.get(wishes, F.col("n_nationkey") % 5).alias("color_ramp")
    )
    ramps = color.color_ramps(spark)
    colors = color.interpolate_ramp(color.ramp_lookup(asked, ramps), ramps)
    return color.color_map(breaks, colors, ("scenario_id",))


@query("color_map", sql(_LEGEND + "select * from legend", "cells", "scenarios"))
def color_map(spark, sf):
    return _legend(spark, sf)


@query(
    "classify_cells",
    sql(
        _LEGEND
        + """,hit as (select s.scenario_id, s.gx, s.gy, s.value, min(l.k) as class from sums s
  left join legend l on l.scenario_id = s.scenario_id and s.value <= l.brk group by 1, 2, 3, 4)
select h.scenario_id, h.gx, h.gy, h.value, h.class, cast(coalesce(l.rgba, 0) as bigint) as rgba
from hit h left join legend l on l.scenario_id = h.scenario_id and l.k = h.class""",
        "cells",
        "scenarios",
    ),
)
def classify_cells(spark, sf):
    cells = fx.cells(spark, sf)
    over = scenarios.scenario_overlay(cells, fx.LAYERS, fx.scenarios(spark, sf), fx.GRID, mask_layer=None)
    classed = color.classify_cells(over, _legend(spark, sf), ("scenario_id",))
    return classed.select("scenario_id", "gx", "gy", "value", "class", "rgba")


_DENSE = """+present as (select distinct layer, zoom, tc, tr from cells),
dense as (select p.layer, p.zoom, p.tc, p.tr, cast(p.tc * 32 + i % 32 as int) as gx, cast(p.tr * 32 + (i - i % 32) / 32 as int) as gy, i from present p cross join (select unnest(range(1024)) as i) r),
filled as (select d.*, c.value, c.gx is not null as known from dense d left join cells c on c.layer = d.layer and c.gx = d.gx and c.gy = d.gy)
"""


@query(
    "densify_tiles",
    sql(_DENSE + "select layer, zoom, tc, tr, gx, gy, case when known then value else 0 end as value from filled", "cells"),
)
def densify_tiles(spark, sf):
    return tiles.densify_tiles(fx.cells(spark, sf), fx.GRID, fill=0).select(*CELL)


@query(
    "pack_tiles",
    sql(
        _DENSE
        + f"""select layer, zoom, tc, tr, cast({" + ".join(f"(((tc >> {i}) & 1) + ((tr >> {i}) & 1) * 2) * {4**i}::bigint" for i in range(15))} as bigint) as z,
  count(*) as n, cast(sum((i + 1) * coalesce(value, -1)) as bigint) as checksum from filled group by layer, zoom, tc, tr""",
        "cells",
    ),
)
def pack_tiles(spark, sf):
    """Packed arrays, shown by length and a checksum over positions."""
    packed = tiles.pack_tiles(tiles.densify_tiles(fx.cells(spark, sf), fx.GRID), fx.GRID)
    term = "aggregate(transform(cells, (v, i) -> (i + 1) * CAST(coalesce(v, -1) AS BIGINT)), 0L, (s, t) -> s + t)"
    return packed.selectExpr("layer", "zoom", "tc", "tr", "z", "CAST(size(cells) AS BIGINT) AS n", f"{term} AS checksum")


@query("unpack_tiles", sql(_DENSE + "select layer, zoom, tc, tr, gx, gy, value from filled", "cells"))
def unpack_tiles(spark, sf):
    packed = tiles.pack_tiles(tiles.densify_tiles(fx.cells(spark, sf), fx.GRID), fx.GRID)
    return tiles.unpack_tiles(packed, fx.GRID).select(*CELL)


_BREAKS = [-5, -1, 0, 1, 3, 6]
_COLORS = [0x0000FFFF, 0x4466CCFF, 0x8899AAFF, 0xAA9988FF, 0xCC6644FF, 0xFF0000FF]
# A picture of the whole world: columns and rows.
_PICTURE = (200000, 300000)
_WORLD = (-WORLD_HALF, -WORLD_HALF, WORLD_HALF, WORLD_HALF)

_CLASS = "case when value is null then 0 " + " ".join(f"when value <= {b} then {c}" for b, c in zip(_BREAKS, _COLORS)) + " else 0 end"


@query(
    "wms_overlay",
    sql(
        f"""+over as ({_OVERLAY}),
cols as (select cast(c as int) as col, cast(floor((c + 0.5e0) * 1048576e0 / {_PICTURE[0]}) as int) as gx from (select unnest(range({_PICTURE[0]})) as c) a),
lines as (select cast(r as int) as row, cast(floor((r + 0.5e0) * 1048576e0 / {_PICTURE[1]}) as int) as gy from (select unnest(range({_PICTURE[1]})) as r) b)
select col, row, value, cast({_CLASS} as bigint) as rgba from over join cols using (gx) join lines using (gy)""",
        "cells",
        "weights",
        "mask",
    ),
)
def wms_overlay(spark, sf):
    return image.wms_overlay(
        fx.store(spark, sf), fx.WEIGHTS, fx.GRID, _WORLD, *_PICTURE, breaks=_BREAKS, colors=_COLORS
    )


@query(
    "tile_images",
    sql(
        f"""+over as ({_OVERLAY}),
shown as (select tc, tr, gx, gy, case when value <> 0 then value end as value from over),
inked as (select tc, tr, (gy % 32) * 32 + gx % 32 as i, {_CLASS} as rgba from shown)
select tc, tr, count(*) as known, cast(sum((i + 1) * rgba) as bigint) as checksum from inked group by tc, tr""",
        "cells",
        "weights",
        "mask",
    ),
)
def tile_images(spark, sf):
    """The tile route up to the picture: overlay tiles, classified, made dense and packed as RGBA arrays."""
    over = overlay.overlay_tiles(fx.store(spark, sf), fx.WEIGHTS, fx.GRID)
    inked = over.withColumn("value", color.classify(F.col("value"), _BREAKS, _COLORS)).withColumn("layer", F.lit("overlay"))
    packed = tiles.pack_tiles(tiles.densify_tiles(inked, fx.GRID), fx.GRID)
    term = "aggregate(transform(cells, (v, i) -> (i + 1) * coalesce(v, 0)), 0L, (s, t) -> s + t)"
    return packed.selectExpr("tc", "tr", "CAST(size(filter(cells, v -> v IS NOT NULL)) AS BIGINT) AS known", f"{term} AS checksum")
