"""The routes of sums and breaks as tables of requests: text in, scores or class breaks out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overgrid.functions import cellmath
from overgrid.model import Grid
from overgrid.operators.joins import fan_join
from overgrid.operators.requests import layer_weight_pairs
from overgrid.operators.stats import quantile_breaks
from overgrid.operators.vector import parse_geojson, polygon_edges, polygon_to_pixels, reproject_polygon
from overgrid.operators.zonal import layer_ratio, zonal_parts
from overgrid.plans.scenarios import scenario_histogram


def request_summary(cells: DataFrame, requests: DataFrame, grid: Grid, denominator: str = "tile_area") -> DataFrame:
    """``(req_id, is_valid, layer, is_total, pos, weight, score)`` for requests ``(req_id, geojson, layers, weights)``.

    The polygon is in lon/lat.  A valid request has one row for each pair of its lists, with a NULL score where its
    polygon meets no tile of the layer or the weight is no number, and a total.  A request whose text is no polygon
    has a total row alone, with ``is_valid`` false and a NULL score.  Only the asked pairs of polygon and weights
    are scored; all polygons are summed in one job.
    """
    parsed = parse_geojson(requests.select("req_id", "geojson", "layers", "weights"))
    shapes = polygon_to_pixels(reproject_polygon(parsed.filter("is_valid")), grid)
    edges = polygon_edges(shapes.select(F.col("req_id").alias("zone_id"), "rings"))
    ratios = layer_ratio(zonal_parts(cells, edges, grid), grid, edges, denominator)
    pairs = layer_weight_pairs(parsed.filter("is_valid").select("req_id", "layers", "weights"))
    scored = pairs.join(ratios.select(F.col("zone_id").alias("req_id"), "layer", "ratio"), ["req_id", "layer"], "left")
    scored = scored.withColumn("nano", cellmath.nano(F.col("ratio") * F.col("weight")))
    sums = scored.groupBy("req_id").agg(F.sum("nano").alias("nano"))
    totals = parsed.select("req_id", "is_valid").join(sums, "req_id", "left")
    none = F.lit(None)
    detail = scored.select("req_id", F.lit(True).alias("is_valid"), "layer", F.lit(0).alias("is_total"), "pos", "weight", (F.col("nano") / 1e9).alias("score"))
    total = totals.select(
        "req_id", "is_valid", none.cast("string").alias("layer"), F.lit(1).alias("is_total"), none.cast("int").alias("pos"),
        none.cast("int").alias("weight"), F.when(F.col("is_valid"), F.coalesce("nano", F.lit(0)) / 1e9).alias("score"),
    )
    return detail.unionByName(total)


def request_breaks(cells: DataFrame, requests: DataFrame, layers: Sequence[str], zoom: int) -> DataFrame:
    """``(req_id, k, brk)`` for requests ``(req_id, layers, weights, num_breaks)``, each with its own number of breaks.

    ``layers`` are the layers of the store that requests may name; others, and weights that are no number, are left out.

    Requests of the same weights are one recipe, named by its smallest request: its histogram is made once for all who
    ask it, and breaks once for each number of breaks asked of it.  So the work follows the different recipes, and
    a request costs its own rows of the result.  Rows of one ``req_id`` are taken together.
    """
    pairs = layer_weight_pairs(requests.select("req_id", "layers", "weights")).filter("req_id IS NOT NULL AND weight <> 0")
    entries = pairs.filter(F.col("layer").isin(list(layers))).groupBy("req_id", "layer", "weight").agg(F.count(F.lit(1)).alias("times"))
    recipes = entries.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("layer", "weight", "times"))).alias("recipe"))
    numbers = requests.groupBy("req_id", "num_breaks").agg(F.count(F.lit(1)).cast("int").alias("times"))
    numbers = numbers.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("num_breaks", "times"))).alias("asked"))
    wished = recipes.join(numbers, "req_id")
    named = wished.groupBy("recipe", "asked").agg(F.min("req_id").alias("job"))
    kinds = named.groupBy("recipe").agg(F.min("job").alias("scenario_id"))
    weights = kinds.select("scenario_id", F.inline("recipe")).selectExpr("scenario_id", "layer", "weight * times AS weight")
    jobs = named.join(kinds, "recipe").select("scenario_id", "job", F.inline("asked"))
    jobs = jobs.selectExpr("scenario_id", "job", "explode(array_repeat(num_breaks, times)) AS num_breaks")
    hist = fan_join(scenario_histogram(cells, layers, weights, zoom), jobs, ["scenario_id"])
    breaks = quantile_breaks(hist.select("job", "num_breaks", "value", "n"), "num_breaks", ("job",))
    members = wished.join(named, ["recipe", "asked"]).select("req_id", "job")
    return members.join(breaks, "job").select("req_id", "k", "brk")
