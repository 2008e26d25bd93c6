"""Helpers shared by the operators: written intermediate tables, free column names, plain inputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overgrid.sources.store import shared_folder


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage is cut, and a lost executor
    costs nothing that was finished."""
    path = f"{folder or shared_folder(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: Iterable[str], base: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: further columns of the table cannot clash with our own."""
    return df.select(*[F.col(f"`{was}`").alias(new) for new, was in columns.items()])


def text_of(column: str | Column) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(value: Column, most: int, total: int) -> Column:
    """Whether a row is among about ``most`` of ``total``, picked by 60 bits of a hash: right for any number of rows."""
    h = F.xxhash64(value)
    place = F.pmod(h, F.lit(1 << 20)) * F.lit(1 << 40) + F.pmod(F.shiftrightunsigned(h, 20), F.lit(1 << 40))
    return place < F.lit((1 << 60) * min(most, total) // max(1, total))
