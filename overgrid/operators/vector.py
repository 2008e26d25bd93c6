"""Polygons: parsing, edges, scan conversion, tile cover and masking.

Pixel coordinates run right and down; cell (gx, gy) has its centre at (gx + 0.5, gy + 0.5).  A cell is in a
polygon when a ray from its centre to the right crosses an odd number of edges, holes included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overgrid.functions import projection
from overgrid.model import WORLD_HALF, Grid
from overgrid.operators.grid import within
from overgrid.operators.joins import spread

GEOJSON = (
    "type STRING, coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>>,"
    " geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
)
# Slack, in cells, when looking for the tiles an edge may cross; the exact test follows.
SLACK = 1e-6


def parse_geojson(table: DataFrame, column: str = "geojson") -> DataFrame:
    """Add ``rings`` (NULL if the text is no polygon) and ``is_valid``; bare polygons and features both work."""
    found = (
        "coalesce(CASE WHEN _g.geometry.type = 'Polygon' THEN _g.geometry.coordinates END,"
        " CASE WHEN _g.type = 'Polygon' THEN _g.coordinates END)"
    )
    point = "named_struct('x', get(p, 0), 'y', get(p, 1))"
    rings = f"transform({found}, ring -> transform(ring, p -> {point})) AS rings"
    parsed = table.withColumn("_g", F.from_json(F.col(column), GEOJSON)).selectExpr(*table.columns, rings)
    return parsed.selectExpr("*", "rings IS NOT NULL AS is_valid")


def map_rings(rings: Column, fx, fy) -> Column:
    """Apply ``fx`` to every x and ``fy`` to every y."""
    return F.transform(
        rings, lambda ring: F.transform(ring, lambda p: F.struct(fx(p["x"]).alias("x"), fy(p["y"]).alias("y")))
    )


def reproject_polygon(zones: DataFrame) -> DataFrame:
    """Rings from lon/lat to web mercator."""
    return zones.withColumn("rings", map_rings(F.col("rings"), projection.mercator_x, projection.mercator_y))


def polygon_to_pixels(zones: DataFrame, grid: Grid) -> DataFrame:
    """Rings from web mercator to pixel coordinates."""
    rings = map_rings(
        F.col("rings"),
        lambda x: (x + WORLD_HALF) / grid.cell_size,
        lambda y: (F.lit(WORLD_HALF) - y) / grid.cell_size,
    )
    return zones.withColumn("rings", rings)


def polygon_edges(zones: DataFrame) -> DataFrame:
    """``(zone_id, rings)`` to ``(zone_id, x1, y1, x2, y2)``; open rings are closed.  No shuffle.

    A zone without an id is an error: its cells could not be told from another's.
    """
    turned = "concat(slice(ring, 2, greatest(size(ring) - 1, 0)), slice(ring, 1, 1))"
    pair = "named_struct('x1', p.x, 'y1', p.y, 'x2', q.x, 'y2', q.y)"
    # The outer explode keeps the optimizer from testing the size of every ring expression up front, and the
    # filter makes all uses of the edges alike, whatever joins follow, so that their shuffles are shared.
    checked = zones.selectExpr("CASE WHEN zone_id IS NULL THEN raise_error('a zone has no id') ELSE zone_id END AS zone_id", "rings")
    named = checked.filter("zone_id IS NOT NULL")
    return named.selectExpr("zone_id", "explode_outer(rings) AS ring").selectExpr(
        "zone_id", f"inline(zip_with(ring, {turned}, (p, q) -> {pair}))"
    )


def polygon_spans(edges: DataFrame, side: int, unit: int = 1) -> DataFrame:
    """Scan-convert to runs ``(zone_id, gy, a, b)`` of covered cells, clipped to a ``side`` x ``side`` grid.

    ``unit`` is the cell size: 1 for cells, the tile size for whole tiles judged by their centres.
    """
    scaled = edges.selectExpr("zone_id", *[f"{c} / {unit}e0 AS {c}" for c in ("x1", "y1", "x2", "y2")])
    crossings = (
        scaled.selectExpr(
            "*",
            "CAST(greatest(ceil(least(y1, y2) - 0.5e0), 0) AS INT) AS first_row",
            f"CAST(least(ceil(greatest(y1, y2) - 0.5e0) - 1, {side - 1}) AS INT) AS last_row",
        )
        .filter("first_row <= last_row")
        .selectExpr("zone_id", "x1", "y1", "x2", "y2", "explode(sequence(first_row, last_row)) AS gy")
        .selectExpr("zone_id", "gy", "(x2 - x1) * (gy + 0.5e0 - y1) / (y2 - y1) + x1 AS x")
    )
    line = "(PARTITION BY zone_id, gy ORDER BY x)"
    pairs = crossings.selectExpr("zone_id", "gy", "x", f"lead(x) OVER {line} AS x_end", f"row_number() OVER {line} AS nth")
    return pairs.filter("nth % 2 = 1").selectExpr(
        "zone_id",
        "gy",
        "CAST(greatest(ceil(x - 0.5e0), 0) AS INT) AS a",
        f"CAST(least(ceil(x_end - 0.5e0) - 1, {side - 1}) AS INT) AS b",
    ).filter("a <= b")


def polygon_to_cells(edges: DataFrame, grid: Grid) -> DataFrame:
    """Every covered cell ``(zone_id, gx, gy)``."""
    return polygon_spans(edges, grid.size).selectExpr("zone_id", "explode(sequence(a, b)) AS gx", "gy")


def polygon_sweep(edges: DataFrame, grid: Grid) -> DataFrame:
    """One sweep over the rows of each zone: what ``polygon_cover`` and ``outline_spans`` are read off.

    Each edge is walked once, by cell row (a crossing with the row's middle) and by tile row (the tiles that the edge
    meets).  One shuffle by zone and tile row serves the rest.  In every cell row the crossings and both sides of the
    crossed tiles are sorted by x; running counts tell for the stretch up to the next one whether it is inside the
    polygon and in a crossed tile.  So the work is crossings plus crossed tiles times their rows, however jagged the
    zone, and never its area.

    ``(zone_id, tr, gy, tc, starts, in_tile, inside, a, b)``: ``starts`` marks the left side of a crossed tile ``tc``,
    ``a .. b`` are the cells of the stretch (none if ``a > b``).
    """
    t, last, side = grid.tile, grid.tiles - 1, grid.size

    def x_at(y: str) -> str:
        inside = f"least(greatest({y}, least(y1, y2)), greatest(y1, y2))"
        return f"x1 + (x2 - x1) * ({inside} - y1) / nullif(y2 - y1, 0e0)"

    def either(of_tiles: str, of_cells: str) -> str:
        return f"CASE WHEN by_tile THEN {of_tiles} ELSE {of_cells} END"

    edge = ["zone_id", "x1", "y1", "x2", "y2"]
    rows = (
        edges.selectExpr(*edge, "explode(array(true, false)) AS by_tile")
        .selectExpr(
            *edge, "by_tile",
            f"CAST(greatest({either(f'floor((least(y1, y2) - {SLACK!r}D) / {t})', 'ceil(least(y1, y2) - 0.5e0)')}, 0) AS INT) AS first_row",
            f"CAST({either(f'least(floor((greatest(y1, y2) + {SLACK!r}D) / {t}), {last})', f'least(ceil(greatest(y1, y2) - 0.5e0) - 1, {side - 1})')} AS INT) AS last_row",
        )
        .filter("first_row <= last_row")
        .selectExpr(*edge, "by_tile", "explode(sequence(first_row, last_row)) AS row")
    )
    # A flat edge has no x at a height; it spans its own ends.
    reach = rows.selectExpr(
        *edge, "by_tile", "row",
        either("NULL", "(x2 - x1) * (row + 0.5e0 - y1) / nullif(y2 - y1, 0e0) + x1") + " AS x",
        f"coalesce({x_at(f'row * {t} - {SLACK!r}D')}, x1) AS xa", f"coalesce({x_at(f'(row + 1) * {t} + {SLACK!r}D')}, x2) AS xb",
    ).selectExpr(
        *edge, "by_tile", "row", "x",
        either(f"CAST(greatest(floor((least(xa, xb) - {SLACK!r}D) / {t}), 0) AS INT)", "0") + " AS first_col",
        either(f"CAST(least(floor((greatest(xa, xb) + {SLACK!r}D) / {t}), {last}) AS INT)", "0") + " AS last_col",
    )
    met = spread(
        reach.filter("first_col <= last_col")
        .selectExpr(*edge, "by_tile", "row", "x", "explode(sequence(first_col, last_col)) AS col")
        .filter(f"NOT by_tile OR ({_edge_meets_box(t, 'col', 'row')})")
        .selectExpr("zone_id", "by_tile", f"CAST({either('row', f'floor(row / {t}e0)')} AS INT) AS tr", either("NULL", "row") + " AS gy", either("col", "NULL") + " AS tc", "x"),
        "zone_id",
        "tr",
    )
    # A tile that several edges meet is crossed once.
    before = "lag(tc) OVER (PARTITION BY zone_id, tr ORDER BY by_tile DESC, tc)"
    once = met.selectExpr("*", f"{before} AS _before").filter("NOT by_tile OR _before IS NULL OR _before <> tc")
    marks = once.selectExpr(
        "zone_id", "tr", "tc", "x",
        f"explode({either(f'sequence(tr * {t}, tr * {t} + {t - 1})', 'array(gy)')}) AS gy", "by_tile",
    ).selectExpr("zone_id", "tr", "gy", "tc", "x", "explode(" + either("array(-1, 1)", "array(0)") + ") AS mark").selectExpr(
        "zone_id", "tr", "gy", "tc", "mark", f"CASE mark WHEN 1 THEN CAST(tc * {t} AS DOUBLE) WHEN -1 THEN CAST((tc + 1) * {t} AS DOUBLE) ELSE x END AS x"
    )
    row = "(PARTITION BY zone_id, tr, gy ORDER BY x, mark)"
    upto = "(PARTITION BY zone_id, tr, gy ORDER BY x, mark ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return marks.selectExpr(
        "zone_id", "tr", "gy", "mark", "x", f"lead(x) OVER {row} AS x_end",
        f"sum(mark) OVER {upto} AS open", f"sum(CASE WHEN mark = 0 THEN 1 ELSE 0 END) OVER {upto} AS crossings",
        f"max(CASE WHEN mark = 1 THEN tc END) OVER {upto} AS tc",
    ).selectExpr(
        "zone_id", "tr", "gy", "tc", "mark = 1 AS starts", "open > 0 AS in_tile", "crossings % 2 = 1 AS inside",
        "CAST(greatest(ceil(x - 0.5e0), 0) AS INT) AS a", f"CAST(least(ceil(x_end - 0.5e0) - 1, {side - 1}) AS INT) AS b",
    )


def _edge_meets_box(t: int, tc: str, tr: str) -> str:
    """Separating-axis test of the closed segment against the closed tile box."""
    left, top, right, bottom = f"({tc} * {t})", f"({tr} * {t})", f"(({tc} + 1) * {t})", f"(({tr} + 1) * {t})"
    corners = ", ".join(
        f"(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)" for x in (left, right) for y in (top, bottom)
    )
    return (
        f"greatest(x1, x2) >= {left} AND least(x1, x2) <= {right}"
        f" AND greatest(y1, y2) >= {top} AND least(y1, y2) <= {bottom}"
        f" AND least({corners}) <= 0 AND greatest({corners}) >= 0"
    )


def polygon_cover(edges: DataFrame, grid: Grid) -> DataFrame:
    """Tiles ``(zone_id, tc, tr, whole)`` that a polygon meets; ``whole`` ones lie inside it altogether."""
    return swept_cover(polygon_sweep(edges, grid), grid)


def swept_cover(sweep: DataFrame, grid: Grid) -> DataFrame:
    """The cover from a sweep.

    A tile that no edge meets is all in or all out, and its first row tells which: stretches of that row between
    crossed tiles are made of whole tiles.
    """
    t = grid.tile
    first = sweep.filter(f"gy = tr * {t} AND (starts OR (NOT in_tile AND inside AND a <= b))")
    columns = f"CASE WHEN starts THEN sequence(tc, tc) ELSE sequence(CAST(floor(a / {t}e0) AS INT), CAST(floor(b / {t}e0) AS INT)) END"
    return first.selectExpr("zone_id", f"explode({columns}) AS tc", "tr", "NOT starts AS whole")


def polygon_touched_tiles(edges: DataFrame, grid: Grid) -> DataFrame:
    return polygon_cover(edges, grid).select("zone_id", "tc", "tr")


def outline_spans(edges: DataFrame, grid: Grid) -> DataFrame:
    """Runs ``(zone_id, tc, tr, gy, a, b)`` of covered cells inside the tiles that the outline crosses."""
    return swept_spans(polygon_sweep(edges, grid))


def swept_spans(sweep: DataFrame) -> DataFrame:
    return sweep.filter("in_tile AND inside AND a <= b").select("zone_id", "tc", "tr", "gy", "a", "b")


#: The row number of an entry that stands for a whole tile.
WHOLE_TILE = -1


def swept_parts(sweep: DataFrame, grid: Grid) -> DataFrame:
    """Cover and outline spans in one table ``(zone_id, tc, tr, gy, a, b, whole)``; a tile of the cover has ``gy = WHOLE_TILE``."""
    t = grid.tile
    none = "CAST(NULL AS INT)"
    tile = f"'gy', {WHOLE_TILE}, 'a', {none}, 'b', {none}, 'whole'"
    first, stretch = f"gy = tr * {t}", "inside AND a <= b"
    kinds = (
        f"CASE WHEN {first} AND starts THEN array(named_struct('tc', tc, {tile}, false)) END",
        f"CASE WHEN {first} AND NOT in_tile AND {stretch} THEN transform(sequence(CAST(floor(a / {t}e0) AS INT), CAST(floor(b / {t}e0) AS INT)), c -> named_struct('tc', c, {tile}, true)) END",
        f"CASE WHEN in_tile AND {stretch} THEN array(named_struct('tc', tc, 'gy', gy, 'a', a, 'b', b, 'whole', CAST(NULL AS BOOLEAN))) END",
    )
    said = f"{first} AND (starts OR ({stretch})) OR in_tile AND {stretch}"
    return sweep.filter(said).selectExpr("zone_id", "tr", f"explode(flatten(filter(array({', '.join(kinds)}), k -> k IS NOT NULL))) AS p").select(
        "zone_id", "p.tc", "tr", "p.gy", "p.a", "p.b", "p.whole"
    )


def swept_rows(sweep: DataFrame, grid: Grid) -> DataFrame:
    """Every cell row of the tiles that a polygon meets, cut where the outline crosses it: ``(zone_id, tc, tr, gy, a, b, inside)``."""
    t = grid.tile
    whole = (
        f"transform(sequence(CAST(floor(a / {t}e0) AS INT), CAST(floor(b / {t}e0) AS INT)),"
        f" c -> named_struct('tc', c, 'top', tr * {t}, 'bottom', tr * {t} + {t - 1}, 'a', c * {t}, 'b', c * {t} + {t - 1}, 'inside', true))"
    )
    outline = "array(named_struct('tc', tc, 'top', gy, 'bottom', gy, 'a', a, 'b', b, 'inside', inside))"
    told = sweep.filter(f"a <= b AND (in_tile OR gy = tr * {t} AND inside)")
    cut = told.selectExpr("zone_id", "tr", f"explode(CASE WHEN in_tile THEN {outline} ELSE {whole} END) AS p")
    return cut.selectExpr("zone_id", "p.tc", "tr", "explode(sequence(p.top, p.bottom)) AS gy", "p.a", "p.b", "p.inside")


def mask_by_polygon(cells: DataFrame, edges: DataFrame, grid: Grid, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Per zone, the cells of the tiles it meets, NODATA where a cell lies outside the polygon.

    Cells meet the cut rows of the zones' tiles in one join and are not moved again once they are repeated for each
    zone.  It is asked to merge: Spark's size check counts the edges, not the rows that come out of them, and would
    broadcast those at any size.  A tile under very many zones is a hot key of a plain join, which Spark splits.
    ``bounds`` around the zones reach the scan.
    """
    rows = swept_rows(polygon_sweep(edges, grid), grid)
    met = within(cells, bounds).join(rows.hint("merge"), ["tc", "tr", "gy"]).filter("gx BETWEEN a AND b")
    rest = [c for c in cells.columns if c != "value"]
    return met.selectExpr("zone_id", *rest, "CASE WHEN inside THEN value END AS value")
