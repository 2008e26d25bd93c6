"""Many weight vectors in one job.

``scenarios`` is ``(scenario_id, layer, weight, ...)``.  Layers are aggregated once per cell, not once per
scenario: cells with the same values in the same layers share a signature, there are few of them, and each
scenario scores signatures instead of cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overgrid.functions import cellmath
from overgrid.model import Grid, place_keys
from overgrid.operators.grid import with_tile_key
from overgrid.operators.joins import fan_join
from overgrid.operators.stats import histogram_exact, quantile_breaks
from overgrid.operators.zonal import layer_ratio, zonal_parts
from overgrid.plans.overlay import MASK, mask_tiles
from overgrid.plans.summary import with_total


SHOWN = "shown"


#: Layers whose bits one BIGINT holds; more layers take more words.
WORD = 62


def _words(layers: Sequence[str]) -> range:
    return range(-(-len(layers) // WORD))


def _key(layers: Sequence[str]) -> list[str]:
    flags = [f"{kind}{w}" for w in _words(layers) for kind in ("has", "gaps")]
    return [*flags, *[f"v{i}" for i in range(len(layers))], SHOWN]


def _bits(layers: Sequence[str], word: int) -> Column:
    """The bit of each layer in one word."""
    bit: Column = F.lit(None).cast("bigint")
    for i, name in enumerate(layers[word * WORD : (word + 1) * WORD]):
        bit = F.when(F.col("layer") == name, F.lit(1 << i).cast("bigint")).otherwise(bit)
    return bit


def signatures(cells: DataFrame, layers: Sequence[str], mask_layer: str | None = None) -> DataFrame:
    """One row per covered cell: its place and its signature.

    The signature is ``has0..`` and ``gaps0..`` (bit i: layer i covers the cell, has NODATA there), the values
    ``v0..`` (0 where there is none) and ``shown`` (whether the mask shows the cell).  Cells of tiles that the mask
    lacks are left out.  No part is NULL, so
    it joins and groups by plain equality, and fixed-width aggregates keep it in a hash aggregate with
    map-side partials.
    """
    wanted = list(layers) + ([mask_layer] if mask_layer else [])
    layer, value = F.col("layer"), F.col("value")
    none = F.lit(0).cast("bigint")
    aggs = []
    for w in _words(layers):
        bit = _bits(layers, w)
        aggs.append(F.coalesce(F.sum(bit), none).alias(f"has{w}"))
        aggs.append(F.coalesce(F.sum(F.when(value.isNull(), bit)), none).alias(f"gaps{w}"))
    aggs += [F.coalesce(F.max(F.when(layer == name, value)), F.lit(0)).alias(f"v{i}") for i, name in enumerate(layers)]
    aggs.append(F.count(F.when(layer == mask_layer, value) if mask_layer else F.lit(1)).alias("mask_data"))
    chosen = cells.filter(layer.isin(wanted))
    place = place_keys(cells, "zoom", "tc", "tr", "gx", "gy")
    found = chosen.groupBy(*place).agg(*aggs)
    found = found.filter(" OR ".join(f"has{w} <> 0" for w in _words(layers))).withColumn(SHOWN, F.col("mask_data") > 0)
    if mask_layer:
        tiles = mask_tiles(chosen, mask_layer)
        found = found.join(tiles, tiles.columns, "left_semi")
    return found.select("zoom", "gx", "gy", *_key(layers))


def score_signatures(
    sigs: DataFrame,
    layers: Sequence[str],
    scenarios: DataFrame,
    nodata: str = "propagate",
    keep: tuple[str, ...] = (),
    named: str | None = None,
) -> DataFrame:
    """Value of each distinct signature in each scenario: ``(*signature, *keep, scenario_id, value)``.

    With ``named``, a column that tells the signatures apart, it stands for the signature in the result, and only it
    is grouped by.  A scenario that weighs none of a signature's layers does not cover it and gives no row.
    """
    key = [*([named, SHOWN] if named else _key(layers)), *keep]
    slots = [
        F.struct(
            F.lit(name).alias("layer"),
            F.col(f"has{i // WORD}").bitwiseAND(F.lit(1 << i % WORD)).alias("bit"),
            F.when(F.col(f"gaps{i // WORD}").bitwiseAND(F.lit(1 << i % WORD)) == 0, F.col(f"v{i}").cast("bigint")).alias("v"),
        )
        for i, name in enumerate(layers)
    ]
    rows = sigs.select(*key, F.inline(F.filter(F.array(*slots), lambda e: e["bit"] != 0)))
    weights = scenarios.filter(F.col("weight") != 0).select("scenario_id", "layer", F.col("weight").cast("bigint").alias("w"))
    scaled = fan_join(rows, weights, ["layer"]).withColumn("scaled", F.col("v") * F.col("w"))
    scored = scaled.groupBy(*key, "scenario_id").agg(cellmath.add_values(F.col("scaled"), nodata=nodata).alias("value"))
    return scored.withColumn("value", F.when(F.col(SHOWN), F.col("value")))


def signature_ids(pixels: DataFrame, layers: Sequence[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pixels ``(zoom, gx, gy, sig)``, and the dictionary ``(sig, *signature)`` with one row for each id.

    The id is a hash of the signature.  Two signatures of one id are told apart by a second hash, of which the
    dictionary's aggregate sees the least and the greatest: they are an error that asks for another ``seed``.
    """
    key = _key(layers)
    named = pixels.withColumn("sig", F.xxhash64(F.lit(seed), *key))
    again = F.xxhash64(F.lit(~seed), *key)
    whole = named.groupBy("sig").agg(*[F.any_value(c).alias(c) for c in key], F.min(again).alias("_least"), F.max(again).alias("_most"))
    clash = F.raise_error(F.lit("two signatures have one id: take another seed"))
    known = whole.select(F.when(F.col("_least") == F.col("_most"), F.col("sig")).otherwise(clash).alias("sig"), *key)
    return named.select("zoom", "gx", "gy", "sig"), known


def scenario_overlay(
    cells: DataFrame,
    layers: Sequence[str],
    scenarios: DataFrame,
    grid: Grid,
    mask_layer: str | None = MASK,
    nodata: str = "propagate",
    seed: int = 0,
) -> DataFrame:
    """Masked overlay of every scenario: ``(scenario_id, zoom, tc, tr, gx, gy, value)``.

    Cells meet their signature's scores by its id (``signature_ids``), one number whatever the layers; a signature
    that most cells share is a hot key of a plain join, which Spark splits.
    """
    pixels, known = signature_ids(signatures(cells.filter(F.col("zoom") == grid.zoom), layers, mask_layer), layers, seed)
    scored = score_signatures(known, layers, scenarios, nodata, named="sig")
    out = fan_join(pixels, scored.select("sig", "scenario_id", "value"), ["sig"])
    return with_tile_key(out, grid).select("scenario_id", "zoom", "tc", "tr", "gx", "gy", "value")


def scenario_histogram(cells: DataFrame, layers: Sequence[str], scenarios: DataFrame, zoom: int) -> DataFrame:
    """Cells per value of every scenario's unmasked overlay: ``(scenario_id, value, n)``."""
    key = _key(layers)
    typed = cells.filter(F.col("zoom") == zoom).withColumn("value", cellmath.as_type(F.col("value"), "smallint"))
    counted = signatures(typed, layers).groupBy(*key).agg(F.count(F.lit(1)).alias("cells"))
    scored = score_signatures(counted, layers, scenarios, keep=("cells",))
    return histogram_exact(scored, ("scenario_id",), weight=F.col("cells"))


def scenario_breaks(
    cells: DataFrame, layers: Sequence[str], scenarios: DataFrame, num_breaks: int | DataFrame, zoom: int
) -> DataFrame:
    """Quantile breaks ``(scenario_id, k, brk)`` of every scenario's unmasked overlay.

    ``num_breaks`` is one number for all, or a table ``(scenario_id, num_breaks)``.

    Everything after the count per signature is as small as the number of signatures.
    """
    hist = scenario_histogram(cells, layers, scenarios, zoom)
    if isinstance(num_breaks, DataFrame):
        hist = fan_join(hist, num_breaks.select("scenario_id", "num_breaks"), ["scenario_id"])
        return quantile_breaks(hist, "num_breaks", ("scenario_id",))
    return quantile_breaks(hist, num_breaks, ("scenario_id",))


def scenario_zonal_summary(
    cells: DataFrame,
    edges: DataFrame,
    scenarios: DataFrame,
    asked: DataFrame,
    grid: Grid,
    denominator: str = "tile_area",
) -> DataFrame:
    """Scores of the asked pairs ``(zone_id, scenario_id)``, with totals.

    Sums and counts are made once per zone and layer; scenarios only weigh them.  As in ``zonal_summary`` every
    layer of a scenario has a row, with a NULL score where the zone meets no tile of it, and every pair a total.
    """
    ratios = layer_ratio(zonal_parts(cells, edges, grid), grid, edges, denominator)
    weights = scenarios.select("scenario_id", "layer", "pos", "weight")
    pairs = fan_join(asked.select("zone_id", "scenario_id").distinct(), weights, ["scenario_id"])
    scored = pairs.join(ratios, ["zone_id", "layer"], "left").withColumn(
        "nano", cellmath.nano(F.col("ratio") * F.col("weight"))
    )
    return with_total(scored, "zone_id", "scenario_id")
