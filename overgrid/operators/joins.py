"""Helpers for joins with few distinct keys and for shuffles whose rows grow once read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fan_join(facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join ``facts`` with a much smaller ``lookup`` whose keys may be hot.

    A plain join on purpose: every row of either side is shuffled once, however many partitions the cluster has, and
    where a key's partition comes out too large, adaptive execution splits it and repeats only that part of the
    lookup.  A small lookup is broadcast by Spark's own size check.  Repeating lookup rows beforehand would cost the
    more the larger the cluster.
    """
    return facts.join(lookup, on, how)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by keys into all of the session's ``spark.sql.shuffle.partitions``.

    Adaptive execution merges parts by their size as shuffled.  Where a part's rows are then exploded, sorted or
    collected, a task holds twenty to sixty times that size, so such parts are not to be merged.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
