"""Layer configuration: which layers exist, their default weights and display names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = (
    "title STRING, weightedOverlay STRUCT<numBreaks: STRING, opacity: STRING, ramp: STRING,"
    " layers: ARRAY<STRUCT<name: STRING, weight: STRING, display: STRING>>>"
)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return layer_config(spark.read.schema(CONFIG).json(path, multiLine=True))


def parse_config(texts: DataFrame, column: str = "config") -> DataFrame:
    """Configurations held as JSON text in a column; the other columns are kept."""
    rest = [c for c in texts.columns if c != column]
    parsed = texts.select(*rest, F.from_json(column, CONFIG).alias("_c"))
    return layer_config(parsed.select(*rest, "_c.*"), rest)


def layer_config(configs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per listed layer with typed weight, and the defaults of its configuration."""
    keep = keep or []
    return configs.select(
        *keep,
        F.col("weightedOverlay.numBreaks").try_cast("int").alias("num_breaks"),
        F.col("weightedOverlay.opacity").try_cast("double").alias("opacity"),
        F.col("weightedOverlay.ramp").alias("ramp"),
        F.posexplode("weightedOverlay.layers").alias("pos", "l"),
    ).select(
        *keep,
        "num_breaks",
        "opacity",
        "ramp",
        "pos",
        F.col("l.name").alias("layer"),
        F.col("l.weight").try_cast("int").alias("weight"),
        F.col("l.display").alias("display"),
    )
