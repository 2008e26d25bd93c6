"""Inputs derived from the driver's tables, once as DataFrames and once as SQL text for the oracle.

A pixel number p is spread over the map by taking its even bits as gx and its odd bits as gy.  So the map is
square, equally dense at every scale factor, and grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overgrid.functions.zcurve import z_decode_x, z_decode_y
from overgrid.model import CELL_KEYS, Grid
from overgrid.operators.grid import with_tile_key
from overgrid.operators.vector import polygon_edges

GRID = Grid(tile=32, zoom=15)
BITS = 20
LAYERS = ["AF", "AO", "NF", "NO", "RF", "RO"]
WEIGHTS = {"AF": -5, "NF": 2, "RF": 4, "AO": 1, "NO": 0, "RO": 3}
DISPLAY = {"AF": "Built up", "AO": "Wet", "NF": "Wooded", "NO": "Protected", "RF": "Tilled"}
KITE = [(-1.0, 0.0), (0.03125, -1.0), (2.0, 0.03125), (0.03125, 1.0)]
RAMP_WISHES = ["blue-to-red", "no-such-ramp", "muted-terrain-qualitative", "yellow-to-red-heatmap", "bold-land-use-qualitative"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _on_map(pixels: DataFrame) -> DataFrame:
    """Pixel number ``p`` to its place.  The generator keeps the optimizer from copying the long bit
    expressions into every later filter and key, as it would with a plain projection."""
    rest = [c for c in pixels.columns if c != "p"]
    spot = F.struct(z_decode_x("p", BITS).alias("gx"), z_decode_y("p", BITS).alias("gy"))
    placed = pixels.select(*rest, F.inline_outer(F.array(spot)))
    return with_tile_key(placed.withColumn("zoom", F.lit(GRID.zoom)), GRID)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Six sparse 0/1 layers with explicit NODATA."""
    items = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("layer"),
        F.expr("coalesce(l_orderkey * 4 + l_partkey % 4, 0)").alias("p"),
        F.expr("CASE WHEN l_quantity >= 46 THEN NULL WHEN l_quantity >= 10 THEN 1 ELSE 0 END").alias("value"),
    )
    flat = items.groupBy("layer", "p").agg(F.max("value").cast("int").alias("value"))
    return _on_map(flat).select(*CELL_KEYS, "value")


def mask(spark: SparkSession, sf: str) -> DataFrame:
    """Mask layer: 1 inside one disc per 128 x 128 cells, NODATA outside, some tiles and some cells left out."""
    spread = table(spark, sf, "orders").select(F.expr("explode(array(o_orderkey * 4, o_orderkey * 4 + 1, o_orderkey * 4 + 2, o_orderkey * 4 + 3))").alias("p"))
    placed = _on_map(spread).filter("(tc * 7 + tr * 3) % 11 <> 0 AND (gx * 5 + gy * 3) % 41 <> 0")
    disc = "CASE WHEN (gx % 128 - 64) * (gx % 128 - 64) + (gy % 128 - 64) * (gy % 128 - 64) < 3600 THEN 1 END"
    return placed.withColumns({"layer": F.lit("mask"), "value": F.expr(disc)}).select(*CELL_KEYS, "value")


def store(spark: SparkSession, sf: str) -> DataFrame:
    """Layers and mask together, as a layer store holds them."""
    return cells(spark, sf).unionByName(mask(spark, sf))


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """One kite per supplier, in pixel coordinates, open ring; every 25th is six times as large."""
    size = "CAST((6 + s_suppkey % 20) * (CASE WHEN s_suppkey % 25 = 3 THEN 6 ELSE 1 END) AS DOUBLE) AS r"
    centre = table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS zone_id", "coalesce(s_suppkey * 600 + 317, 0) AS p", size)
    placed = _on_map(centre)
    ring = ", ".join(f"named_struct('x', gx + r * {dx!r}D, 'y', gy + r * {dy!r}D)" for dx, dy in KITE)
    return placed.selectExpr("zone_id", f"array(array({ring})) AS rings")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return polygon_edges(zones(spark, sf))


def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """25 weight vectors in -5..5."""
    listed = ", ".join(f"named_struct('layer', '{name}', 'pos', {i})" for i, name in enumerate(LAYERS))
    rows = table(spark, sf, "nation").selectExpr("n_nationkey AS scenario_id", f"inline(array({listed}))")
    return rows.withColumn("weight", F.expr("CAST((scenario_id * 3 + pos * 5) % 11 - 5 AS INT)"))


def asked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Three scenarios asked for each zone."""
    rows = table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS zone_id", "explode(sequence(0, 2)) AS j")
    return rows.selectExpr("zone_id", "CAST((zone_id * 7 + j * 3) % 25 AS INT) AS scenario_id")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per customer: lists of 3/3, 2/3 and 4/3 entries, a wished ramp, a number of breaks."""
    ramps = F.array(*[F.lit(r) for r in RAMP_WISHES])
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("bigint").alias("req_id"),
        F.expr(
            "concat(CASE WHEN c_custkey % 3 = 0 THEN 'AF,NF,RF' WHEN c_custkey % 3 = 1 THEN 'RO,AO' ELSE 'NO,AF,RO,NF' END,"
            " CASE WHEN c_custkey % 11 = 0 THEN ',' ELSE '' END)"
        ).alias("layers"),
        F.expr(
            "concat(CAST(c_custkey % 5 - 2 AS STRING), CASE WHEN c_custkey % 7 = 0 THEN ',x,' ELSE ',3,' END,"
            " CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE '' END, CAST(1 + c_custkey % 4 AS STRING), CASE WHEN c_custkey % 13 = 0 THEN ',,' ELSE '' END)"
        ).alias("weights"),
        F.expr("CAST(1 + c_custkey % 13 AS INT)").alias("num_breaks"),
        F.get(ramps, F.expr("CAST(c_custkey % 5 AS INT)")).alias("color_ramp"),
    )


def wanted_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tile requests, one per customer, spread over the map and a little beyond its data."""
    spots = table(spark, sf, "customer").select("c_custkey", F.expr("coalesce(c_custkey * 50 + 7, 0)").alias("p"))
    keyed = _on_map(spots).select(F.col("c_custkey").cast("bigint").alias("req_id"), "zoom", "tc", "tr")
    layer = F.get(F.array(*[F.lit(name) for name in LAYERS]), F.expr("CAST(req_id % 6 AS INT)"))
    return keyed.select("req_id", layer.alias("layer"), "zoom", "tc", "tr")


def geojson(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles in lon/lat: bare, as features, and every tenth no JSON."""
    ring = (
        "concat('[[[-85.', CAST(100 + c_custkey % 400 AS STRING), ',34.', CAST(200 + c_custkey % 300 AS STRING),"
        " '],[-84.', CAST(600 + c_custkey % 300 AS STRING), ',34.5],[-85.0,35.', CAST(100 + c_custkey % 50 AS STRING), ']]]')"
    )
    text = (
        "CASE WHEN c_custkey % 10 = 0 THEN 'not json'"
        " WHEN c_custkey % 2 = 0 THEN concat('{\"type\":\"Polygon\",\"coordinates\":', ring, '}')"
        " ELSE concat('{\"type\":\"Feature\",\"properties\":{},\"geometry\":{\"type\":\"Polygon\",\"coordinates\":', ring, '}}') END"
    )
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(ring).alias("ring"))
    return rows.select(F.col("c_custkey").cast("bigint").alias("geom_id"), F.expr(text).alias("geojson"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Samples in lon/lat."""
    return table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("layer"),
        "value",
        F.expr("-86.0D + 1.5D * ((event_id * 7919) % 10007) / 10007").alias("lon"),
        F.expr("34.2D + 1.2D * ((event_id * 104729) % 10009) / 10009").alias("lat"),
    )


# --- the same inputs for the oracle ---------------------------------------------------------------------


def _bits(p: str, odd: int) -> str:
    """Every second bit of p, packed (a rule, not a table)."""
    return " + ".join(f"((({p}) >> {2 * i + odd}) & 1) * {1 << i}" for i in range(BITS))


def _place(p: str) -> str:
    return f"cast({_bits(p, 0)} as int) as gx, cast({_bits(p, 1)} as int) as gy"


def _values(rows: list[str], names: str) -> str:
    return f"(select * from (values {', '.join(rows)}) as v({names}))"


_WEIGHT_ROWS = [f"('{name}', {i}, {w})" for i, (name, w) in enumerate(WEIGHTS.items())]
_KITE_ROWS = [f"({i}, {dx!r}e0, {dy!r}e0)" for i, (dx, dy) in enumerate(KITE)]
_LAYER_ROWS = [f"('{name}', {i})" for i, name in enumerate(LAYERS)]
_RAMP_CASE = " ".join(f"when {i} then '{r}'" for i, r in enumerate(RAMP_WISHES))

CTES: dict[str, tuple[list[str], str]] = {
    "cells": (
        [],
        f"""select layer, {GRID.zoom} as zoom, cast(floor(gx / 32e0) as int) as tc, cast(floor(gy / 32e0) as int) as tr,
  gx, gy, value from (select layer, {_place('p')}, value from (
    select concat(l_returnflag, l_linestatus) as layer, l_orderkey * 4 + l_partkey % 4 as p,
      cast(max(case when l_quantity >= 46 then null when l_quantity >= 10 then 1 else 0 end) as int) as value
    from lineitem group by 1, 2) a) b""",
    ),
    "mask": (
        [],
        f"""select 'mask' as layer, {GRID.zoom} as zoom, tc, tr, gx, gy,
  cast(case when (gx % 128 - 64) * (gx % 128 - 64) + (gy % 128 - 64) * (gy % 128 - 64) < 3600 then 1 end as int) as value
from (select gx, gy, cast(floor(gx / 32e0) as int) as tc, cast(floor(gy / 32e0) as int) as tr
  from (select {_place('o_orderkey * 4 + j')} from orders cross join (values (0), (1), (2), (3)) as q(j)) a) b
where (tc * 7 + tr * 3) % 11 <> 0 and (gx * 5 + gy * 3) % 41 <> 0""",
    ),
    "weights": ([], f"select * from {_values(_WEIGHT_ROWS, 'layer, pos, weight')} w"),
    "vertices": (
        [],
        f"""select zone_id, pos, gx + r * dx as x, gy + r * dy as y from (
  select cast(s_suppkey as bigint) as zone_id, {_place('s_suppkey * 600 + 317')},
    cast((6 + s_suppkey % 20) * (case when s_suppkey % 25 = 3 then 6 else 1 end) as double) as r from supplier) a
  cross join {_values(_KITE_ROWS, 'pos, dx, dy')} k""",
    ),
    "edges": (
        ["vertices"],
        """select p.zone_id, p.x as x1, p.y as y1, q.x as x2, q.y as y2
from vertices p join vertices q on p.zone_id = q.zone_id and q.pos = (p.pos + 1) % 4""",
    ),
    "box": (
        ["vertices"],
        "select zone_id, min(x) as xmin, max(x) as xmax, min(y) as ymin, max(y) as ymax from vertices group by zone_id",
    ),
    # cells of any layer in a zone, by casting a ray against every edge
    "spots": (["cells"], "select distinct gx, gy, tc, tr from cells"),
    "inside": (
        ["spots", "edges", "box"],
        """select b.zone_id, s.gx, s.gy, s.tc, s.tr from spots s
join box b on s.gx + 0.5e0 between b.xmin and b.xmax and s.gy + 0.5e0 between b.ymin and b.ymax
join edges e on e.zone_id = b.zone_id
 and (e.y1 > s.gy + 0.5e0) <> (e.y2 > s.gy + 0.5e0)
 and s.gx + 0.5e0 < (e.x2 - e.x1) * (s.gy + 0.5e0 - e.y1) / (e.y2 - e.y1) + e.x1
group by 1, 2, 3, 4, 5 having count(*) % 2 = 1""",
    ),
    # every cell of the grid in a zone, covered by a layer or not
    "filled": (
        ["edges", "box"],
        """select zone_id, gx, gy from (
  select b.zone_id, cast(x.i as int) as gx, cast(y.i as int) as gy, b.xmin, b.xmax, b.ymin, b.ymax from box b,
    lateral (select unnest(range(cast(greatest(floor(b.xmin), 0) as bigint), cast(ceil(b.xmax) as bigint))) as i) x,
    lateral (select unnest(range(cast(greatest(floor(b.ymin), 0) as bigint), cast(ceil(b.ymax) as bigint))) as i) y) c
join edges e using (zone_id)
where (e.y1 > c.gy + 0.5e0) <> (e.y2 > c.gy + 0.5e0)
 and c.gx + 0.5e0 < (e.x2 - e.x1) * (c.gy + 0.5e0 - e.y1) / (e.y2 - e.y1) + e.x1
group by 1, 2, 3 having count(*) % 2 = 1""",
    ),
    "touched": (
        ["edges", "box", "filled"],
        """select zone_id, tc, tr from (
  select b.zone_id, cast(x.i as int) as tc, cast(y.i as int) as tr from box b,
    lateral (select unnest(range(cast(greatest(floor(b.xmin / 32) - 1, 0) as bigint), cast(floor(b.xmax / 32) + 1 as bigint))) as i) x,
    lateral (select unnest(range(cast(greatest(floor(b.ymin / 32) - 1, 0) as bigint), cast(floor(b.ymax / 32) + 1 as bigint))) as i) y) c
join edges e using (zone_id)
where greatest(x1, x2) >= tc * 32 and least(x1, x2) <= tc * 32 + 32
  and greatest(y1, y2) >= tr * 32 and least(y1, y2) <= tr * 32 + 32
  and not ((x2 - x1) * (tr * 32 - y1) > (y2 - y1) * (tc * 32 - x1) and (x2 - x1) * (tr * 32 - y1) > (y2 - y1) * (tc * 32 + 32 - x1)
    and (x2 - x1) * (tr * 32 + 32 - y1) > (y2 - y1) * (tc * 32 - x1) and (x2 - x1) * (tr * 32 + 32 - y1) > (y2 - y1) * (tc * 32 + 32 - x1))
  and not ((x2 - x1) * (tr * 32 - y1) < (y2 - y1) * (tc * 32 - x1) and (x2 - x1) * (tr * 32 - y1) < (y2 - y1) * (tc * 32 + 32 - x1)
    and (x2 - x1) * (tr * 32 + 32 - y1) < (y2 - y1) * (tc * 32 - x1) and (x2 - x1) * (tr * 32 + 32 - y1) < (y2 - y1) * (tc * 32 + 32 - x1))
union select zone_id, cast(floor(gx / 32e0) as int), cast(floor(gy / 32e0) as int) from filled""",
    ),
    "scenarios": (
        [],
        f"""select n_nationkey as scenario_id, layer, pos, cast((n_nationkey * 3 + pos * 5) % 11 - 5 as int) as weight
from nation cross join {_values(_LAYER_ROWS, 'layer, pos')} w""",
    ),
    "asked": (
        [],
        "select cast(s_suppkey as bigint) as zone_id, cast((s_suppkey * 7 + j * 3) % 25 as int) as scenario_id from supplier cross join (values (0), (1), (2)) as q(j)",
    ),
    "requests": (
        [],
        f"""select cast(c_custkey as bigint) as req_id,
  concat(case when c_custkey % 3 = 0 then 'AF,NF,RF' when c_custkey % 3 = 1 then 'RO,AO' else 'NO,AF,RO,NF' end, case when c_custkey % 11 = 0 then ',' else '' end) as layers,
  concat(cast(c_custkey % 5 - 2 as varchar), case when c_custkey % 7 = 0 then ',x,' else ',3,' end,
    case when c_custkey % 17 = 0 then ' ' else '' end, cast(1 + c_custkey % 4 as varchar), case when c_custkey % 13 = 0 then ',,' else '' end) as weights,
  cast(1 + c_custkey % 13 as int) as num_breaks, case c_custkey % 5 {_RAMP_CASE} end as color_ramp from customer""",
    ),
    "wanted": (
        [],
        f"""select req_id, list_value('AF', 'AO', 'NF', 'NO', 'RF', 'RO')[1 + req_id % 6] as layer, {GRID.zoom} as zoom,
  cast(floor(gx / 32e0) as int) as tc, cast(floor(gy / 32e0) as int) as tr
from (select cast(c_custkey as bigint) as req_id, {_place('c_custkey * 50 + 7')} from customer) a""",
    ),
    "geojson": (
        [],
        """select cast(c_custkey as bigint) as geom_id, case when c_custkey % 10 = 0 then 'not json'
  when c_custkey % 2 = 0 then concat('{"type":"Polygon","coordinates":', ring, '}')
  else concat('{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":', ring, '}}') end as geojson
from (select c_custkey, concat('[[[-85.', cast(100 + c_custkey % 400 as varchar), ',34.', cast(200 + c_custkey % 300 as varchar),
  '],[-84.', cast(600 + c_custkey % 300 as varchar), ',34.5],[-85.0,35.', cast(100 + c_custkey % 50 as varchar), ']]]') as ring from customer) t""",
    ),
    "points": (
        [],
        """select event_id, event_type as layer, value,
  -86.0e0 + 1.5e0 * ((event_id * 7919) % 10007) / 10007 as lon, 34.2e0 + 1.2e0 * ((event_id * 104729) % 10009) / 10009 as lat from events""",
    ),
    "mercator": (
        ["points"],
        "select *, 6378137e0 * radians(lon) as x, 6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)) as y from points",
    ),
}


def sql(body: str, *names: str) -> str:
    """``body`` behind the named inputs and what they need."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in ordered:
            for other in CTES[name][0]:
                need(other)
            ordered.append(name)

    for name in names:
        need(name)
    head = ",\n".join(f"{name} as ({CTES[name][1]})" for name in ordered)
    rest = body.strip()
    joiner = ",\n" if rest.startswith("+") else "\n"
    return f"with recursive {head}{joiner}{rest.lstrip('+')}"
