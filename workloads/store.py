"""Queries of sources, the layer store and its metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from overgrid.model import Grid
from overgrid.plans import overlay
from overgrid.sources import config, ingest, store
from workloads import fixtures as fx
from workloads.fixtures import sql
from workloads.gridding import _LEVELS, H, R
from workloads.local import _OVERLAY
from workloads.registry import query

CELL = ["layer", "zoom", "tc", "tr", "gx", "gy", "value"]
INGEST_GRID = Grid(tile=8, zoom=10)


def sources(sf: str) -> list[dict]:
    """Three sources: samples in lon/lat from a text of their own, accounts in web mercator."""
    lon = "-86.0D + 1.5D * ((event_id * 7919) % 10007) / 10007"
    lat = "34.2D + 1.2D * ((event_id * 104729) % 10009) / 10009"

    def table(name: str) -> dict:
        return {"type": "file", "path": f"{sf}/{name}.parquet"}

    return [
        {
            "name": "clicks", "format": "parquet", "backend": table("events"), "crs": "EPSG:4326",
            "filter": "event_type = 'click'",
            "columns": {"id": "event_id", "x": lon, "y": lat, "value": "floor(value)"},
        },
        {
            "name": "samples", "format": "parquet", "backend": table("events"), "crs": "EPSG:4326",
            "columns": {"id": "event_id", "x": lon, "y": lat, "value": "CASE WHEN value >= 5 THEN 1 ELSE 0 END"},
        },
        {
            "name": "accounts", "format": "parquet", "backend": table("customer"), "crs": "EPSG:3857",
            "columns": {
                "id": "c_custkey", "x": "c_custkey * 7919 % 1000003 * 11D - 9000000D",
                "y": "c_custkey * 104729 % 1000003 * 7D - 3000000D", "value": "nullif(CAST(c_custkey % 5 AS INT), 3)",
            },
        },
    ]


_N = float(INGEST_GRID.size)
_GX, _GY = f"(x + {H}) / (2e0 * {H}) * {_N!r}e0", f"({H} - y) / (2e0 * {H}) * {_N!r}e0"


@query(
    "ingest_layers",
    sql(
        f"""+geo as (select *, {R} * radians(lon) as x, {R} * ln(tan(pi() / 4 + radians(lat) / 2)) as y from points),
raw as (select 'clicks' as layer, event_id as id, x, y, cast(floor(value) as int) as value from geo where layer = 'click'
  union all select 'samples', event_id, x, y, case when value >= 5 then 1 else 0 end from geo
  union all select 'accounts', c_custkey, c_custkey * 7919 % 1000003 * 11e0 - 9000000e0, c_custkey * 104729 % 1000003 * 7e0 - 3000000e0,
    cast(nullif(c_custkey % 5, 3) as int) from customer),
placed as (select layer, id, value, {_GX} as px, {_GY} as py from raw),
samples as (select layer, cast(floor(px) as int) as gx, cast(floor(py) as int) as gy, value from (
  select *, row_number() over (partition by layer, floor(px), floor(py)
    order by pow(px - floor(px) - 0.5e0, 2) + pow(py - floor(py) - 0.5e0, 2), id) as rn from placed) r where rn = 1),
dense as (select layer, cast(tc * 8 + i % 8 as int) as gx, cast(tr * 8 + (i - i % 8) / 8 as int) as gy
  from (select distinct layer, gx // 8 as tc, gy // 8 as tr from samples) t cross join (select unnest(range(64)) as i) r),
base as (select layer, 10 as zoom, gx, gy, value from dense left join samples using (layer, gx, gy)),
"""
        + _LEVELS.lstrip("+")
        + """,present as (select distinct layer, zoom, gx // 8 as tc, gy // 8 as tr from levels),
whole as (select layer, zoom, cast(tc as int) as tc, cast(tr as int) as tr, cast(tc * 8 + i % 8 as int) as gx, cast(tr * 8 + (i - i % 8) / 8 as int) as gy
  from present cross join (select unnest(range(64)) as i) r)
select w.*, l.value from whole w left join levels l using (layer, zoom, gx, gy)""",
        "points",
    ),
)
def ingest_layers(spark, sf):
    return ingest.ingest_layers(spark, sources(sf), INGEST_GRID).select(*CELL)


_CONFIG = """concat('{"title":"t', cast(c_custkey as varchar), '","weightedOverlay":{"numBreaks":"', cast(4 + c_custkey % 7 as varchar),
  '","opacity":"0.75","ramp":"blue-to-red","layers":[{"name":"AF","weight":"', cast(c_custkey % 11 - 5 as varchar),
  '","display":"Built up"},{"name":"RF","weight":"many","display":"Tilled"}]}}')"""


@query(
    "layer_config",
    f"""select id, cast(4 + id % 7 as int) as num_breaks, 0.75e0 as opacity, 'blue-to-red' as ramp, pos, layer,
  case when pos = 0 then cast(id % 11 - 5 as int) end as weight, display
from (select cast(json_extract_string({_CONFIG}, '$.title')[2:] as bigint) as id from customer) c
cross join (values (0, 'AF', 'Built up'), (1, 'RF', 'Tilled')) as l(pos, layer, display)""",
)
def layer_config(spark, sf):
    """One configuration text per customer; one of its weights is no number."""
    texts = fx.table(spark, sf, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS id", f"{_CONFIG.replace('varchar', 'string')} AS config")
    return config.parse_config(texts)


@query("read_layer", sql("select * from cells where layer in ('AF', 'RO')", "cells"))
def read_layer(spark, sf):
    return store.read_layer(fx.store(spark, sf), ["AF", "RO"], fx.GRID.zoom).select(*CELL)


@query(
    "query_layer_bounds",
    sql("select * from cells where layer = 'NF' and tc >= 1", "cells"),
)
def query_layer_bounds(spark, sf):
    """Everything but the first column of tiles."""
    return store.query_layer_bounds(fx.store(spark, sf), "NF", fx.GRID.zoom, (1, 0, fx.GRID.tiles - 1, fx.GRID.tiles - 1)).select(*CELL)


@query(
    "read_tile",
    sql("select * from cells where (layer, tc, tr) in (select (layer, tc, tr) from wanted)", "cells", "wanted"),
)
def read_tile(spark, sf):
    return store.read_tile(fx.cells(spark, sf), fx.wanted_tiles(spark, sf)).select(*CELL)


@query(
    "missing_tiles",
    sql(
        """select req_id, w.layer, w.zoom, w.tc, w.tr from wanted w
left join (select distinct layer, tc, tr from cells) c on c.layer = w.layer and c.tc = w.tc and c.tr = w.tr where c.layer is null""",
        "cells",
        "wanted",
    ),
)
def missing_tiles(spark, sf):
    return store.missing_tiles(fx.cells(spark, sf), fx.wanted_tiles(spark, sf)).select("req_id", "layer", "zoom", "tc", "tr")


@query(
    "layer_metadata",
    sql(
        """select layer, zoom, min(tc) as c0, min(tr) as r0, max(tc) as c1, max(tr) as r1, min(gx) as gx0, min(gy) as gy0,
  max(gx) as gx1, max(gy) as gy1, count(distinct (tc, tr)) as tiles, count(*) as cells, count(value) as data_cells,
  round(min(gx) * 40075016.685578488e0 / 1048576 - 20037508.342789244e0, 3) as xmin, round(20037508.342789244e0 - max(gy + 1) * 40075016.685578488e0 / 1048576, 3) as ymin,
  round(max(gx + 1) * 40075016.685578488e0 / 1048576 - 20037508.342789244e0, 3) as xmax, round(20037508.342789244e0 - min(gy) * 40075016.685578488e0 / 1048576, 3) as ymax
from (select * from cells union all select * from mask) s group by layer, zoom""",
        "cells",
        "mask",
    ),
)
def layer_metadata(spark, sf):
    told = store.layer_metadata(fx.store(spark, sf), fx.GRID.tile)
    return told.withColumns({c: F.round(c, 3) for c in ("xmin", "ymin", "xmax", "ymax")})


@query("write_layer", sql("select * from cells union all select * from mask", "cells", "mask"))
def write_layer(spark, sf):
    """Written to a store in the shared folder and read back."""
    path = store.shared_folder(spark)
    store.write_layer(fx.store(spark, sf), path)
    return store.open_store(spark, path)


@query("bucketed_overlay", sql(_OVERLAY, "cells", "weights", "mask"))
def bucketed_overlay(spark, sf):
    """The overlay on a table bucketed by tile, where it needs no shuffle."""
    path = store.shared_folder(spark)
    table, buckets = path.rsplit("/", 1)[1].replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    store.write_buckets(fx.store(spark, sf), table, path, buckets)
    held = store.open_buckets(spark, table, path, buckets)
    return overlay.weighted_overlay(held, fx.WEIGHTS, fx.GRID)
