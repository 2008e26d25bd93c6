"""Queries over many weight vectors at once."""

from __future__ import annotations

from overgrid.plans import scenarios
from workloads import fixtures as fx
from workloads.fixtures import sql
from workloads.registry import query
from workloads.zones import _NEEDS, _PARTS

_SUMS = """select scenario_id, zoom, tc, tr, gx, gy, case when count(value) < count(*) then null else cast(sum(value * weight) as bigint) end as value
  from cells join scenarios using (layer) where weight <> 0 group by scenario_id, zoom, tc, tr, gx, gy"""


@query(
    "scenario_overlay",
    sql(
        f"""select s.scenario_id, s.zoom, s.tc, s.tr, s.gx, s.gy, case when m.value is not null then s.value end as value
from ({_SUMS}) s join (select distinct tc, tr from mask) t on t.tc = s.tc and t.tr = s.tr left join mask m on m.gx = s.gx and m.gy = s.gy""",
        "cells",
        "mask",
        "scenarios",
    ),
)
def scenario_overlay(spark, sf):
    return scenarios.scenario_overlay(fx.store(spark, sf), fx.LAYERS, fx.scenarios(spark, sf), fx.GRID)


@query(
    "scenario_breaks",
    sql(
        f"""+sums as ({_SUMS}),
ordered as (select scenario_id, value, row_number() over (partition by scenario_id order by value) as rn,
  count(*) over (partition by scenario_id) as total from sums where value is not null)
select scenario_id, k, min(value) as brk from ordered, (select cast(unnest(range(1, 11)) as int) as k) ks
where rn * 10 >= k * total group by scenario_id, k""",
        "cells",
        "scenarios",
    ),
)
def scenario_breaks(spark, sf):
    return scenarios.scenario_breaks(fx.cells(spark, sf), fx.LAYERS, fx.scenarios(spark, sf), 10, fx.GRID.zoom)


@query(
    "scenario_zonal_summary",
    sql(
        _PARTS
        + """,scored as (select zone_id, scenario_id, layer, s.pos, s.weight,
  cast(floor(total / cast(cell_count as double) * s.weight * 1e9) as bigint) as nano
  from asked join scenarios s using (scenario_id) left join ratios using (zone_id, layer))
select zone_id, scenario_id, layer, pos, weight, 0 as is_total, nano / 1e9 as score from scored
union all select zone_id, scenario_id, null, null, null, 1, cast(coalesce(sum(nano), 0) as bigint) / 1e9 from scored group by zone_id, scenario_id""",
        *_NEEDS,
        "scenarios",
        "asked",
    ),
)
def scenario_zonal_summary(spark, sf):
    """Three scenarios for each zone."""
    return scenarios.scenario_zonal_summary(
        fx.cells(spark, sf), fx.edges(spark, sf), fx.scenarios(spark, sf), fx.asked_pairs(spark, sf), fx.GRID
    )
