"""Queries of cells held as runs."""

from __future__ import annotations

from overgrid.operators import runs
from workloads import fixtures as fx
from workloads.fixtures import sql
from workloads.local import _OVERLAY
from workloads.registry import query

_RUNS = """select layer, zoom, tc, tr, gy, min(gx) as x0, max(gx) as x1, any_value(value) as value
from (select *, gx - row_number() over (partition by layer, zoom, tc, tr, gy, value order by gx) as g from {}) s
group by layer, zoom, tc, tr, gy, value, g"""


@query("cells_to_runs", sql(_RUNS.format("(select * from cells union all select * from mask) u"), "cells", "mask"))
def cells_to_runs(spark, sf):
    return runs.cells_to_runs(fx.store(spark, sf))


@query("runs_to_cells", sql("select * from mask", "mask"))
def runs_to_cells(spark, sf):
    """The mask as runs and back."""
    return runs.runs_to_cells(runs.cells_to_runs(fx.mask(spark, sf)))


@query("overlay_runs", sql(_OVERLAY, "cells", "weights", "mask"))
def overlay_runs(spark, sf):
    """The weighted overlay by a sweep over run ends, told by cell."""
    held = runs.cells_to_runs(fx.store(spark, sf))
    return runs.runs_to_cells(runs.overlay_runs(held, fx.WEIGHTS, fx.GRID.zoom))


@query(
    "overlay_runs_ignore",
    sql(
        "+over as ("
        + _OVERLAY.replace("case when count(value) < count(*) then null else cast(sum(value * weight) as bigint) end", "cast(sum(value * weight) as bigint)")
        + "),\nlabelled as (select *, '' as layer from over)\n"
        + _RUNS.format("labelled").replace("select layer, ", "select "),
        "cells",
        "weights",
        "mask",
    ),
)
def overlay_runs_ignore(spark, sf):
    """NODATA left out of the sums; the result as runs."""
    return runs.overlay_runs(runs.cells_to_runs(fx.store(spark, sf)), fx.WEIGHTS, fx.GRID.zoom, nodata="ignore")
