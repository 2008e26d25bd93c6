"""Queries of the cell-wise operators, the overlay and its breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from overgrid.functions import cellmath
from overgrid.operators import local, requests, stats
from overgrid.operators.joins import spread
from overgrid.plans import overlay
from workloads import fixtures as fx
from workloads.fixtures import sql
from workloads.registry import query

CELL = ["layer", "zoom", "tc", "tr", "gx", "gy", "value"]


@query(
    "convert_cell_type",
    sql(
        """select layer, zoom, tc, tr, gx, gy,
  cast(case when value * 40000 between -32768 and 32767 then value * 40000 end as smallint) as narrow,
  cast(coalesce(value, -32768) as smallint) as sentinel from cells""",
        "cells",
    ),
)
def convert_cell_type(spark, sf):
    cells = fx.cells(spark, sf)
    wide = cells.withColumn("value", F.col("value") * 40000)
    both = local.convert_cell_type(wide, "smallint").withColumnRenamed("value", "narrow")
    marked = cellmath.to_sentinel(F.col("value"), -32768).cast("smallint")
    kept = cells.withColumn("sentinel", marked).withColumn("value", F.col("value") * 40000)
    out = local.convert_cell_type(kept, "smallint").withColumnRenamed("value", "narrow")
    return out.select(*both.columns, "sentinel")


@query(
    "multiply_scalar",
    sql(
        """select layer, zoom, tc, tr, gx, gy, cast(value * weight as bigint) as value
from cells join weights using (layer)""",
        "cells",
        "weights",
    ),
)
def multiply_scalar(spark, sf):
    return local.multiply_scalar(fx.cells(spark, sf), fx.WEIGHTS).select(*CELL)


@query(
    "multiply_scalar_table",
    sql(
        """select scenario_id, layer, tc, tr, cast(sum(value * weight) as bigint) as total, count(*) as n
from cells join scenarios using (layer) group by scenario_id, layer, tc, tr""",
        "cells",
        "scenarios",
    ),
)
def multiply_scalar_table(spark, sf):
    """Weights from a table; shown as sums per tile."""
    weights = fx.scenarios(spark, sf).select("scenario_id", "layer", "weight")
    # A tile's cells are together before they are multiplied: a task then sums its own tiles, not all of the map's.
    scaled = local.multiply_scalar(spread(fx.cells(spark, sf), "tc", "tr"), weights)
    return scaled.groupBy("scenario_id", "layer", "tc", "tr").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


@query(
    "local_add",
    sql(
        """select zoom, tc, tr, gx, gy,
  case when count(value) < count(*) then null else cast(sum(value) as bigint) end as propagated,
  cast(sum(value) as bigint) as ignored from cells group by zoom, tc, tr, gx, gy""",
        "cells",
    ),
)
def local_add(spark, sf):
    cells = fx.cells(spark, sf)
    strict = local.local_add(cells).withColumnRenamed("value", "propagated")
    loose = local.local_add(cells, nodata="ignore").withColumnRenamed("value", "ignored")
    return strict.join(loose, ["zoom", "tc", "tr", "gx", "gy"])


@query(
    "local_mask",
    sql(
        """select c.layer, c.zoom, c.tc, c.tr, c.gx, c.gy, cast(case when m.value is null then null else c.value end as bigint) as value
from cells c join (select distinct tc, tr from mask) t on c.tc = t.tc and c.tr = t.tr
left join mask m on m.gx = c.gx and m.gy = c.gy""",
        "cells",
        "mask",
    ),
)
def local_mask(spark, sf):
    return local.local_mask(fx.cells(spark, sf), fx.mask(spark, sf)).select(*CELL)


@query(
    "local_mask_values",
    sql(
        """select c.layer, c.zoom, c.tc, c.tr, c.gx, c.gy, cast(case when m.value = 1 then -9 else c.value end as bigint) as value
from cells c join (select distinct tc, tr from mask) t on c.tc = t.tc and c.tr = t.tr
left join mask m on m.gx = c.gx and m.gy = c.gy""",
        "cells",
        "mask",
    ),
)
def local_mask_values(spark, sf):
    """Other parameters: write -9 where the mask is 1."""
    return local.local_mask(fx.cells(spark, sf), fx.mask(spark, sf), read_mask=1, write_mask=-9).select(*CELL)


@query(
    "map_cells",
    sql("select layer, zoom, tc, tr, gx, gy, case when value = 1 then 7 else value end as value from cells", "cells"),
)
def map_cells(spark, sf):
    return local.map_cells(fx.cells(spark, sf), lambda v: F.when(v == 1, F.lit(7)).otherwise(v)).select(*CELL)


@query(
    "zero_to_nodata",
    sql("select layer, zoom, tc, tr, gx, gy, case when value <> 0 then value end as value from cells", "cells"),
)
def zero_to_nodata(spark, sf):
    return local.zero_to_nodata(fx.cells(spark, sf)).select(*CELL)


_PAIRS = """+cut as (select * replace (rtrim(layers, ',') as layers, rtrim(weights, ',') as weights) from requests),
pairs as (select req_id, cast(i - 1 as int) as pos, string_split(layers, ',')[i] as layer,
  case when regexp_full_match(string_split(weights, ',')[i], '[+-]?[0-9]+') then try_cast(string_split(weights, ',')[i] as int) end as weight
  from (select *, unnest(range(1, 1 + least(len(string_split(layers, ',')), len(string_split(weights, ','))))) as i from cut) r)
"""


@query("layer_weight_pairs", sql(_PAIRS + "select * from pairs", "requests"))
def layer_weight_pairs(spark, sf):
    return requests.layer_weight_pairs(fx.requests(spark, sf).select("req_id", "layers", "weights"))


@query(
    "active_layers",
    sql(
        _PAIRS
        + """select req_id, string_agg(layer, ',' order by pos) as layers, string_agg(cast(weight as varchar), ',' order by pos) as weights
from pairs where weight <> 0 group by req_id""",
        "requests",
    ),
)
def active_layers(spark, sf):
    pairs = requests.layer_weight_pairs(fx.requests(spark, sf).select("req_id", "layers", "weights"))
    return requests.active_layers(pairs, "req_id")


@query(
    "weight_label",
    sql(
        _PAIRS
        + "select req_id, pos, case when weight > 0 then '+' || cast(weight as varchar) else cast(weight as varchar) end as label from pairs",
        "requests",
    ),
)
def weight_label(spark, sf):
    pairs = requests.layer_weight_pairs(fx.requests(spark, sf).select("req_id", "layers", "weights"))
    return pairs.select("req_id", "pos", requests.weight_label(F.col("weight")).alias("label"))


_OVERLAY = """select s.zoom, s.tc, s.tr, s.gx, s.gy, case when m.value is not null then s.value end as value from (
  select zoom, tc, tr, gx, gy, case when count(value) < count(*) then null else cast(sum(value * weight) as bigint) end as value
  from cells join weights using (layer) where weight <> 0 group by zoom, tc, tr, gx, gy) s
join (select distinct tc, tr from mask) t on t.tc = s.tc and t.tr = s.tr left join mask m on m.gx = s.gx and m.gy = s.gy"""


@query("weighted_overlay", sql(_OVERLAY, "cells", "weights", "mask"))
def weighted_overlay(spark, sf):
    return overlay.weighted_overlay(fx.store(spark, sf), fx.WEIGHTS, fx.GRID)


@query(
    "weighted_overlay_ignore",
    sql(
        _OVERLAY.replace("case when count(value) < count(*) then null else cast(sum(value * weight) as bigint) end", "cast(sum(value * weight) as bigint)"),
        "cells",
        "weights",
        "mask",
    ),
)
def weighted_overlay_ignore(spark, sf):
    """NODATA left out of the sum instead of spreading."""
    return overlay.weighted_overlay(fx.store(spark, sf), fx.WEIGHTS, fx.GRID, nodata="ignore")



@query(
    "overlay_tiles",
    sql(
        f"""+over as ({_OVERLAY})
select zoom, tc, tr, gx, gy, case when value <> 0 then value end as value from over
where (tc, tr) in (select (tc, tr) from wanted)""",
        "wanted",
        "cells",
        "weights",
        "mask",
    ),
)
def overlay_tiles(spark, sf):
    return overlay.overlay_tiles(fx.store(spark, sf), fx.WEIGHTS, fx.GRID, fx.wanted_tiles(spark, sf))


@query(
    "overlay_tiles_polygon",
    sql(
        f"""+over as ({_OVERLAY})
select t.zone_id, o.zoom, o.tc, o.tr, o.gx, o.gy, case when i.gx is not null and o.value <> 0 then o.value end as value
from over o join touched t using (tc, tr) left join inside i on i.zone_id = t.zone_id and i.gx = o.gx and i.gy = o.gy""",
        "cells",
        "weights",
        "mask",
        "touched",
        "inside",
    ),
)
def overlay_tiles_polygon(spark, sf):
    """The same with polygon masks, one result per zone."""
    tiles = overlay.overlay_tiles(fx.store(spark, sf), fx.WEIGHTS, fx.GRID, edges=fx.edges(spark, sf))
    return tiles.select("zone_id", "zoom", "tc", "tr", "gx", "gy", "value")


@query(
    "histogram_exact",
    sql("select layer, value, count(*) as n from cells where value is not null group by layer, value", "cells"),
)
def histogram_exact(spark, sf):
    return stats.histogram_exact(fx.cells(spark, sf), ("layer",))


# Many distinct values: pixel position mixed into a signed number, over several ranges of the running sum.
_SPREAD = "cast((gx * 4099 + gy * 911) % 300007 - 150003 as int)"


@query(
    "quantile_breaks",
    sql(
        "+ks as (select cast(unnest(range(1, 13)) as int) as k),\n"
        + "\n".join(
            [
                f"v as (select layer, {_SPREAD} as value from cells where value is not null)",
                "select layer, k, cast(quantile_disc(value, k / 12e0) as int) as brk from v, ks group by layer, k",
            ]
        ),
        "cells",
    ).replace("quantile_disc(value, k / 12e0)", "list_sort(list(value))[cast((count(*) * k + 11) // 12 as bigint)]"),
)
def quantile_breaks(spark, sf):
    values = fx.cells(spark, sf).filter("value IS NOT NULL").withColumn("value", F.expr(_SPREAD))
    return stats.quantile_breaks(stats.histogram_exact(values, ("layer",)), 12, ("layer",))


@query(
    "weighted_breaks",
    sql(
        """+sums as (select gx, gy, case when count(value) < count(*) then null else cast(sum(value * weight) as bigint) end as value
  from cells join weights using (layer) where weight <> 0 group by gx, gy),
ordered as (select value, row_number() over (order by value) as rn, count(*) over () as total from sums where value is not null)
select k, min(value) as brk from ordered, (select cast(unnest(range(1, 11)) as int) as k) ks where rn * 10 >= k * total group by k""",
        "cells",
        "weights",
    ),
)
def weighted_breaks(spark, sf):
    return overlay.weighted_breaks(fx.cells(spark, sf), fx.WEIGHTS, 10, fx.GRID.zoom)
