"""Queries over changed stores: statistics that are merged or replaced, a pyramid rebuilt in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from overgrid.operators import changes, grid
from overgrid.sources import store
from workloads import fixtures as fx
from workloads.fixtures import sql
from workloads.gridding import _LEVELS
from workloads.registry import query

CELL = ["layer", "zoom", "tc", "tr", "gx", "gy", "value"]

# The change: in some tiles of every layer values are turned over and one column in four is deleted.
CHANGED = "(tc * 5 + tr * 3) % 7 = 0"
GONE = "gx % 4 = 1"
_AFTER = f"""+altered as (select layer, zoom, tc, tr, gx, gy, case when {CHANGED} then 1 - value else value end as value
from cells where not ({CHANGED} and {GONE}))
"""
_METADATA = """select layer, zoom, min(tc) as c0, min(tr) as r0, max(tc) as c1, max(tr) as r1, min(gx) as gx0, min(gy) as gy0,
  max(gx) as gx1, max(gy) as gy1, count(distinct (tc, tr)) as tiles, count(*) as cells, count(value) as data_cells
from {} group by layer, zoom"""


def _altered(cells):
    kept = cells.filter(f"NOT ({CHANGED} AND {GONE})")
    return kept.withColumn("value", F.expr(f"CASE WHEN {CHANGED} THEN 1 - value ELSE value END"))


@query("appended_metadata", sql(_METADATA.format("(select * from cells union all select * from mask) s"), "cells", "mask"))
def appended_metadata(spark, sf):
    """A store written in three batches; metadata from the merged statistics alone."""
    path = store.shared_folder(spark)
    held = fx.store(spark, sf)
    parts = {"even": "layer <> 'mask' AND gx % 2 = 0", "mask": "layer = 'mask'", "odd": "layer <> 'mask' AND gx % 2 <> 0"}
    for batch in parts:
        store.write_batch(held.filter(parts[batch]), path, batch)
    return changes.metadata_of(store.open_statistics(spark, path))


@query(
    "appended_totals",
    sql(
        "select layer, zoom, count(*) as cells, count(value) as data_cells, cast(coalesce(sum(value), 0) as bigint) as total from cells group by layer, zoom",
        "cells",
    ),
)
def appended_totals(spark, sf):
    """What ratios divide, merged from the statistics of three parts."""
    cells = fx.cells(spark, sf)
    parts = [changes.tile_statistics(cells.filter(F.pmod("gy", F.lit(3)) == i)) for i in range(3)]
    return changes.layer_totals(changes.merge_statistics(*parts))


@query("changed_metadata", sql(_AFTER + _METADATA.format("altered"), "cells"))
def changed_metadata(spark, sf):
    """Statistics of a changed store: only changed tiles are counted again."""
    before = fx.cells(spark, sf)
    keys = before.filter(CHANGED).select(*changes.TILE_KEY).distinct()
    recount = changes.tile_statistics(store.read_tile(_altered(before), keys))
    return changes.metadata_of(changes.replace_statistics(changes.tile_statistics(before), keys, recount))


@query(
    "refreshed_pyramid",
    sql(
        _AFTER
        + _LEVELS.replace("+", ",base as (select layer, zoom, gx, gy, value from altered),\n", 1)
        + f"""select layer, zoom, cast(floor(gx / 32e0) as int) as tc, cast(floor(gy / 32e0) as int) as tr, gx, gy, value
from levels where zoom < {fx.GRID.zoom}""",
        "cells",
    ),
)
def refreshed_pyramid(spark, sf):
    """The pyramid of the store before the change, written, then rebuilt above changed tiles."""
    path = store.shared_folder(spark)
    before = fx.cells(spark, sf)
    store.write_layer(grid.pyramid(before, fx.GRID, keep_base=False), path)
    changed = before.filter(CHANGED).select("layer", "tc", "tr").distinct()
    return changes.refresh_pyramid(_altered(before), store.open_store(spark, path), changed, fx.GRID).select(*CELL)
