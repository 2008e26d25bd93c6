"""The layer store: Parquet partitioned by layer and zoom, sorted along the z-order curve of tiles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overgrid.model import CELL_KEYS, place_keys
from overgrid.operators.changes import merge_statistics, metadata_of, tile_statistics
from overgrid.operators.grid import within, z_order_key

# The storage kinds that are plain paths, and their URI schemes.
SCHEMES = {"file": "file", "hadoop": "hdfs", "s3": "s3a"}


def storage_path(kind: str, path: str) -> str:
    """Location of a store from a kind of storage and a path; unknown kinds are an error."""
    if kind not in SCHEMES:
        raise ValueError(f"unknown storage {kind!r}: use one of {', '.join(SCHEMES)}")
    if "://" in path or path.startswith("file:"):
        return path
    scheme = SCHEMES[kind]
    return f"{scheme}:{path}" if path.startswith("/") and scheme != "s3a" else f"{scheme}://{path.lstrip('/')}"


def write_layer(cells: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None) -> None:
    """Write cells so that each file holds a stretch of one layer's z-order curve.

    The range split is by curve position within layer and zoom, so a layer that holds most of the cells is
    spread over as many files as its size asks for.
    """
    order = ["layer", "zoom", "z"]
    keyed = z_order_key(cells.select(*CELL_KEYS, "value"))
    spread = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    spread.sortWithinPartitions(*order, "gy", "gx").write.mode(mode).partitionBy("layer", "zoom").parquet(path)


# Session settings that suit cell tables.
SETTINGS = {
    # Cell files are tiny next to their rows (runs of 0 and 1), so sizes on disk must not decide on broadcasts.
    "spark.sql.sources.fileCompressionFactor": "128.0",
    # Tables bucketed by tile stay where they are when a join has further keys inside the tile.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Where both sides of a join are in small partitions, hash them instead of sorting.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def tune(spark: SparkSession) -> None:
    """Apply ``SETTINGS`` to the session, except where it has its own values.

    They change how every later query of the session is planned, so nothing in the library calls this.
    """
    defaults = {
        "spark.sql.sources.fileCompressionFactor": "1.0",
        "spark.sql.requireAllClusterKeysForCoPartition": "true",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0b",
    }
    for name, value in SETTINGS.items():
        if spark.conf.get(name, defaults[name]).lower() in (defaults[name], defaults[name].rstrip("b")):
            spark.conf.set(name, value)


def write_buckets(cells: DataFrame, table: str, path: str, buckets: int) -> None:
    """Write cells as a table bucketed by tile: all layers of a tile in one file, sorted by zoom and layer.

    Overlays, masks, signatures and tile sums group by place, and need no shuffle on such a table; filters on
    zoom and layer skip row groups.  A tile holds at most ``tile^2`` cells a layer, so buckets are even.  Take
    a few hundred MB a bucket.
    """
    keyed = z_order_key(cells.select(*CELL_KEYS, "value")).repartition(buckets, "z")
    out = keyed.write.format("parquet").mode("overwrite").bucketBy(buckets, "z").sortBy("zoom", "layer", "z")
    out.option("path", path).saveAsTable(table)


def open_buckets(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """A table of ``write_buckets``, also from another session; the column ``z`` stays, see ``place_keys``.

    A table of that name at another place, or with another number of buckets, is an error.
    """
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (layer STRING, zoom INT, tc INT, tr INT, gx INT, gy INT, value INT, z BIGINT)"
        f" USING parquet CLUSTERED BY (z) SORTED BY (zoom, layer, z) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    if _plain(told["Location"]) != _plain(path) or told["Num Buckets"] != str(buckets):
        raise ValueError(f"{table} is at {told['Location']} in {told['Num Buckets']} buckets, not at {path} in {buckets}")
    return spark.table(table).select(*CELL_KEYS, "value", "z")


def _plain(path: str) -> str:
    return path.removeprefix("file:").replace("//", "/").rstrip("/")


def open_store(spark: SparkSession, path: str, keyed: bool = False) -> DataFrame:
    """All cells of a store.  The schema is fixed, so layer names such as ``01`` stay strings.

    ``keyed`` keeps the curve key ``z``, by which bounds skip what files hold elsewhere (``query_layer_bounds``).
    """
    schema = "tc INT, tr INT, gx INT, gy INT, value INT, z BIGINT, layer STRING, zoom INT"
    return spark.read.schema(schema).parquet(path).select(*CELL_KEYS, "value", *["z"] * keyed)


def read_layer(cells: DataFrame, layers: str | Iterable[str], zoom: int) -> DataFrame:
    """Whole layers at one zoom; both filters prune partitions of a store."""
    names = [layers] if isinstance(layers, str) else list(layers)
    return cells.filter(F.col("layer").isin(names) & (F.col("zoom") == zoom))


def query_layer_bounds(
    cells: DataFrame, layers: str | Iterable[str], zoom: int, bounds: tuple[int, int, int, int]
) -> DataFrame:
    """Layers at one zoom, only tiles within inclusive tile bounds ``(c0, r0, c1, r1)``.

    On cells with their curve key the bounds become ranges of it, see ``within``.
    """
    return within(read_layer(cells, layers, zoom), bounds)


TILE_KEY = ["layer", "zoom", "tc", "tr"]


def in_world(keys: DataFrame) -> DataFrame:
    """Keys ``(zoom, tc, tr)`` of tiles that the square world has; no other key can have a cell.

    To Spark this is a filter on the keys' side of a join, which it needs before it has the keys prune the other side:
    partitions of layers and zooms are left unread, and files meet a runtime filter on the tile.
    """
    return keys.filter("zoom BETWEEN 0 AND 30 AND tc >= 0 AND tr >= 0 AND tc < shiftleft(1, zoom) AND tr < shiftleft(1, zoom)")


def read_tile(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """The cells of a table of tile keys ``(layer, zoom, tc, tr)``; the keys prune the scan, see ``in_world``.

    On cells with their curve key ``z`` (``open_store(keyed=True)``, bucketed tables) the keys are joined by it too, so
    a bucketed table stays where it is.
    """
    wanted = in_world(keys.select(*TILE_KEY))
    if "z" not in cells.columns:
        return cells.join(wanted, TILE_KEY, "left_semi")
    return cells.join(z_order_key(wanted), [*TILE_KEY, "z"], "left_semi")


def missing_tiles(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys for which there is no tile.

    Only key columns of wanted tiles are read, each found tile is one row, and the anti join is as small as the keys.
    """
    found = read_tile(cells.select(*place_keys(cells, *TILE_KEY)), keys.select(*TILE_KEY).distinct()).select(*TILE_KEY).distinct()
    return keys.join(found, TILE_KEY, "left_anti")


def layer_metadata(cells: DataFrame, tile: int | None = None) -> DataFrame:
    """Per layer and zoom: key bounds, pixel bounds, tiles, cells and data cells; with the tile side also the map
    extent ``xmin, ymin, xmax, ymax`` of its cells.

    Counting goes tile by tile first, so that no task sees more than the tiles of one layer.
    """
    return metadata_of(tile_statistics(cells), tile)


def write_batch(cells: DataFrame, path: str, batch: str) -> None:
    """Add cells of places that the store does not have yet, and the statistics of these cells alone.

    A batch has folders of its own for both, so writing it again after a failure repairs it and counts nothing twice.
    The statistics are taken from the written files: ``cells`` are computed once, and no earlier batch is read.
    """
    folder = f"{path.rstrip('/')}/batch={batch}"
    write_layer(cells, folder)
    tile_statistics(open_store(cells.sparkSession, folder)).write.mode("overwrite").parquet(f"{statistics_path(path)}/batch={batch}")


def statistics_path(path: str) -> str:
    return f"{path.rstrip('/')}.statistics"


STATISTICS = "layer STRING, zoom INT, tc INT, tr INT, n BIGINT, d BIGINT, total BIGINT, x0 INT, y0 INT, x1 INT, y1 INT"


def open_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Statistics by tile of a store written in batches, those of all batches merged; cells are not read."""
    return merge_statistics(spark.read.schema(STATISTICS).parquet(statistics_path(path)).drop("batch"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see, under ``spark.checkpoint.dir``.

    Where the cluster names none (tests, one machine) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        # A folder of this machine alone would lose data on a cluster: that is an error, not a fallback.
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="overgrid-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/overgrid-{uuid.uuid4().hex}"
