"""Column expressions over cell values.  NULL stands for NODATA everywhere."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def active(weights: Mapping[str, int]) -> dict[str, int]:
    """The layers that count: a zero weight drops its layer, NODATA included."""
    return {layer: int(w) for layer, w in weights.items() if int(w) != 0}


def weight_of(layer: Column, weights: Mapping[str, int]) -> Column:
    """Weight of a layer as a CASE over literals: no join, and folded by the optimizer."""
    expr = None
    for name, w in weights.items():
        cond, val = layer == F.lit(name), F.lit(int(w)).cast("bigint")
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return F.lit(None).cast("bigint") if expr is None else expr


def add_values(scaled: Column, counted: Column | None = None, nodata: str = "propagate") -> Column:
    """Aggregate that adds cell values.

    ``propagate``: one NODATA among the added cells makes the result NODATA.  ``ignore``: NODATA is left
    out.  ``counted`` (non-NULL for the rows that take part) restricts the aggregate to some rows.
    """
    if nodata == "ignore":
        return F.sum(scaled)
    if nodata != "propagate":
        raise ValueError(f"nodata must be 'propagate' or 'ignore', not {nodata!r}")
    rows = F.count(F.lit(1) if counted is None else counted)
    return F.when(F.count(scaled) == rows, F.sum(scaled))


def zero_as_nodata(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def as_type(value: Column, cell_type: str) -> Column:
    """Change the cell type; what does not fit becomes NODATA."""
    return value.try_cast(cell_type)


def from_sentinel(value: Column, sentinel: int) -> Column:
    return F.nullif(value, F.lit(sentinel))


def to_sentinel(value: Column, sentinel: int) -> Column:
    return F.coalesce(value, F.lit(sentinel))


def nano(score: Column) -> Column:
    """A score in whole billionths, so that sums do not depend on their order."""
    return F.floor(score * 1e9).cast("bigint")
