"""Color ramps, legends and classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overgrid.operators.joins import fan_join

DEFAULT_RAMP = "blue-to-red"
TRANSPARENT = 0

# The twelve ramp keys a client may ask for, with our own stops (RRGGBB).
PALETTES = {
    "blue-to-orange": "2166ac 67a9cf d1e5f0 fddbc7 ef8a62 e6550d",
    "green-to-orange": "31a354 a1d99b fee6ce fdae6b e6550d",
    "blue-to-red": "0000ff 6688ee ffffff ee8866 ff0000",
    "green-to-red-orange": "1a9850 91cf60 fee08b fc8d59 d7301f",
    "light-to-dark-sunset": "fff3b0 fdc086 f27059 b5179e 3a0ca3",
    "light-to-dark-green": "edf8e9 bae4b3 74c476 31a354 006d2c",
    "yellow-to-red-heatmap": "ffffb2 fecc5c fd8d3c f03b20 bd0026",
    "blue-to-yellow-to-red-heatmap": "313695 4575b4 abd9e9 ffffbf fdae61 f46d43 d73027 a50026",
    "dark-red-to-yellow-heatmap": "67000d cb181d fb6a4a fed976 fffff0",
    "purple-to-dark-purple-to-white-heatmap": "bcbddc 756bb1 3f007d dadaeb ffffff",
    "bold-land-use-qualitative": "e41a1c 377eb8 4daf4a 984ea3 ff7f00 ffff33 a65628 f781bf 999999 000000",
    "muted-terrain-qualitative": "c7b299 9caf88 7a9e7e",
}


def color_ramps(spark: SparkSession) -> DataFrame:
    """The ramp stops ``(ramp, stop, r, g, b)``."""
    rows = [
        f"('{ramp}', {i}, {int(stop[0:2], 16)}, {int(stop[2:4], 16)}, {int(stop[4:6], 16)})"
        for ramp, stops in PALETTES.items()
        for i, stop in enumerate(stops.split())
    ]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(ramp, stop, r, g, b)")


def ramp_image(ramp: Column) -> Column:
    return F.concat(F.lit("img/ramps/"), ramp, F.lit(".png"))


def color_list(ramps: DataFrame) -> DataFrame:
    """One JSON object per ramp: its key and its picture."""
    keys = ramps.select(F.col("ramp").alias("key")).distinct()
    return keys.select("key", F.to_json(F.struct("key", ramp_image(F.col("key")).alias("image"))).alias("json"))


def ramp_lookup(requests: DataFrame, ramps: DataFrame, default: str = DEFAULT_RAMP) -> DataFrame:
    """Resolve ``color_ramp`` of each request to a known ``ramp``, or to the default."""
    known = ramps.select(F.col("ramp")).distinct()
    found = fan_join(requests, known.withColumnRenamed("ramp", "color_ramp").withColumn("_known", F.lit(True)), ["color_ramp"], "left")
    ramp = F.when(F.col("_known"), F.col("color_ramp")).otherwise(F.lit(default))
    return found.withColumn("ramp", ramp).drop("_known")


def rgba(r: Column, g: Column, b: Column, a: int = 255) -> Column:
    return (F.shiftleft(r.cast("bigint"), 24) + F.shiftleft(g, 16) + F.shiftleft(b, 8) + F.lit(a)).cast("bigint")


def interpolate_ramp(requests: DataFrame, ramps: DataFrame, n: str = "num_breaks") -> DataFrame:
    """Stretch the ``ramp`` of each request to ``n`` colors: rows ``(..., k, rgba)``, k = 1..n.

    Too few stops are interpolated channel by channel, rounded half up; with enough stops the one at the
    nearest place is taken.
    """
    stop = F.struct("stop", "r", "g", "b")
    held = ramps.groupBy("ramp").agg(F.array_sort(F.collect_list(stop)).alias("_stops"))
    wide = fan_join(requests, held, ["ramp"])
    rows = wide.withColumn("k", F.explode(F.expr(f"sequence(1, {n})"))).filter(F.col(n) > 0)
    count, size = F.col(n), F.size("_stops")
    place = F.when(count == 1, F.lit(0.0)).otherwise((F.col("k") - 1) * (size - 1) / F.greatest(count - 1, F.lit(1)))
    whole = F.when(size < count, F.floor("_place")).otherwise(F.floor(F.col("_place") + 0.5)).cast("int")
    part = F.when(size < count, F.col("_place") - F.col("_at")).otherwise(F.lit(0.0))
    placed = rows.withColumn("_place", place).withColumn("_at", whole).withColumn("_part", part)
    first, then = F.get("_stops", F.col("_at")), F.get("_stops", F.least(F.col("_at") + 1, size - 1))

    def channel(c: str) -> Column:
        return F.floor(first[c] + (then[c] - first[c]) * F.col("_part") + 0.5).cast("int")

    color = rgba(channel("r"), channel("g"), channel("b"))
    return placed.withColumn("rgba", color).drop("_stops", "_place", "_at", "_part")


def color_map(breaks: DataFrame, colors: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Legend: break k with color k."""
    return breaks.select(*by, "k", "brk").join(colors.select(*by, "k", "rgba"), [*by, "k"])


def classify(value: Column, breaks: Sequence[int], colors: Sequence[int], fallback: int = TRANSPARENT) -> Column:
    """Color of a value under known breaks: the first break it does not exceed; NODATA is transparent."""
    expr = F.when(value.isNull(), F.lit(TRANSPARENT).cast("bigint"))
    for brk, color in zip(breaks, colors):
        expr = expr.when(value <= brk, F.lit(color).cast("bigint"))
    return expr.otherwise(F.lit(fallback).cast("bigint"))


def class_index(value: Column, breaks: Sequence[int]) -> Column:
    """Position (from 1) of the first break not below the value, NULL for NODATA or above the last."""
    expr = None
    for i, brk in enumerate(breaks, 1):
        expr = F.when(value <= brk, F.lit(i)) if expr is None else expr.when(value <= brk, F.lit(i))
    return expr


def classify_cells(cells: DataFrame, legend: DataFrame, by: tuple[str, ...], fallback: int = TRANSPARENT) -> DataFrame:
    """Add ``class`` and ``rgba`` under a legend table ``(*by, k, brk, rgba)``, one legend per ``by``.

    Each distinct value, NODATA too, is classified once, under a legend that is one sorted array as long as the breaks
    asked for; cells then take class and color by one equi join on their value.  Cells without a legend give no row.
    """
    entry = F.struct("k", "brk", "rgba")
    held = legend.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_legend"))
    found = F.get(F.filter("_legend", lambda e: F.col("value") <= e["brk"]), F.lit(0))
    hits = fan_join(cells.select(*by, "value").distinct(), held, list(by)).withColumn("_hit", found)
    color = F.when(F.col("value").isNull(), F.lit(TRANSPARENT)).otherwise(F.coalesce("_hit.rgba", F.lit(fallback))).cast("bigint")
    names = [f"_by{i}" for i in range(len(by))]
    known = hits.select(*[F.col(b).alias(n) for b, n in zip(by, names)], F.col("value").alias("_value"), F.col("_hit.k").alias("class"), color.alias("rgba"))
    same = F.col("value").eqNullSafe(F.col("_value"))
    for b, n in zip(by, names):
        same &= F.col(b) == F.col(n)
    return cells.join(known, same).drop("_value", *names)
