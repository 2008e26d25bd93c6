"""Weighted zonal summaries and their report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overgrid.functions import cellmath
from overgrid.model import Grid
from overgrid.operators.joins import fan_join
from overgrid.operators.zonal import layer_ratio, zonal_parts

TOTAL_LABEL, LAYER_LABEL = "Score:", "Layer:"


def zonal_summary(
    cells: DataFrame,
    edges: DataFrame,
    weights: Mapping[str, int],
    grid: Grid,
    denominator: str = "tile_area",
    bounds: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Per zone one row per layer and a total row: ``(zone_id, layer, is_total, pos, weight, score)``.

    A layer of which the zone meets no tile has a NULL score and adds nothing to the total.  ``bounds`` around the
    zones (``zone_bounds``) reach the scan.
    """
    chosen = cells.filter(F.col("layer").isin(list(weights)))
    ratios = layer_ratio(zonal_parts(chosen, edges, grid, bounds), grid, edges, denominator)
    # Fixed, literal list of the request's layers; an explode inside each zone row, not a join.
    request = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(name).alias("layer"), F.lit(int(w)).alias("weight"))
            for i, (name, w) in enumerate(weights.items())
        ]
    )
    asked = edges.select("zone_id").distinct().select("zone_id", F.inline(request))
    scored = asked.join(ratios, ["zone_id", "layer"], "left").withColumn(
        "nano", cellmath.nano(F.col("ratio") * F.col("weight"))
    )
    return with_total(scored, "zone_id")


def with_total(scored: DataFrame, *by: str) -> DataFrame:
    """Add the grand total per ``by`` to rows ``(*by, layer, pos, weight, nano)`` with grouping sets."""
    detail = [*by, "layer", "pos", "weight"]
    grouped = scored.groupingSets([detail, list(by)], *detail).agg(
        F.sum("nano").alias("nano"), F.grouping("layer").cast("int").alias("is_total")
    )
    nano = F.when(F.col("is_total") == 1, F.coalesce("nano", F.lit(0))).otherwise(F.col("nano"))
    return grouped.select(*detail, "is_total", (nano / 1e9).alias("score"))


def summary_report(summary: DataFrame, config: DataFrame) -> DataFrame:
    """Rows as a client shows them: weight, display name, score x 100 at two decimals, total last.

    ``config`` is ``(layer, display)``; a layer without display name is labelled "Layer:".
    """
    names = config.select("layer", "display")
    named = fan_join(summary, names, ["layer"], "left")
    total = F.col("is_total") == 1
    label = F.when(total, F.lit(TOTAL_LABEL)).otherwise(F.coalesce("display", F.lit(LAYER_LABEL)))
    # Whole hundredths of a percent-like score, rounded half away from zero.
    nano = F.round(F.col("score") * 1e9).cast("bigint")
    cents = F.signum(nano) * F.floor((F.abs(nano) + 50000) / 100000)
    percent = F.when(F.col("score").isNotNull(), cents / 100)
    return named.select(
        "zone_id",
        "is_total",
        "pos",
        "weight",
        label.alias("label"),
        percent.alias("percent"),
        F.format_string("%.2f", percent).alias("score_text"),
    ).orderBy("zone_id", "is_total", "pos")
