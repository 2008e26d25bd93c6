"""Exact histograms and quantile class breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Values are narrowed to ranges of 2^16, those of 64 bits to ranges of 2^42 and then 2^21.
RANGE_BITS = 16
RADIX_SHIFTS = {"bigint": (42, 21)}


def histogram_exact(cells: DataFrame, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Cells per value, NODATA excluded: ``(*by, value, n)``.  ``weight`` sums instead of counting rows."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return cells.filter(F.col("value").isNotNull()).groupBy(*by, "value").agg(n.cast("bigint").alias("n"))


def quantile_breaks(hist: DataFrame, n: int | str, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, k, brk)`` for k = 1..n: the smallest value that at least k/n of the cells do not exceed.

    ``n`` is a number or the name of a column that is the same in all rows of a ``by``.  A value is break k exactly if
    its running count steps over k/n of the total, so each histogram row tells its own k's and nothing has to be
    searched.  The same holds for ranges of values, so a histogram is first narrowed to the ranges that hold a break (n
    at most), for 64-bit values twice, and only these are cumulated.  A window sees 2^22 rows of its range at most.
    """
    count = F.col(n) if isinstance(n, str) else F.lit(n)
    zero = F.lit(0).cast("bigint")
    held = hist.select(*by, "value", "n", count.cast("bigint").alias("_n"), zero.alias("_base"), zero.alias("_total"))
    within: list[str] = []
    for step, shift in enumerate(RADIX_SHIFTS.get(dict(hist.dtypes)["value"], (RANGE_BITS,))):
        name = f"_range{step}"
        held = held.withColumn(name, F.shiftright(F.col("value").cast("bigint"), shift))
        sums = held.groupBy(*by, *within, name).agg(
            F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("_n", "_base", "_total")]
        )
        if step == 0:
            sums = sums.withColumn("_total", F.sum("n").over(Window.partitionBy(*by)))
        ranges = _with_breaks(sums, [*by, *within], name)
        held = held.drop("_n", "_base", "_total").join(ranges.select(*by, name, "_n", F.col("_before").alias("_base"), "_total"), [*by, name])
        within = [name]
    each = _with_breaks(held, [*by, *within], "value").select(*by, F.explode(F.sequence("_k0", "_k1")).alias("k"), F.col("value").alias("brk"))
    return each.withColumn("k", F.col("k").cast("int"))


def _with_breaks(counts: DataFrame, within: list[str], order: str) -> DataFrame:
    """Rows that hold a break, with the first and last ``_k0, _k1`` of them and the count ``_before`` of all smaller
    values; rows ``within`` a range start from its ``_base``."""
    upto = F.col("_base") + F.sum("n").over(Window.partitionBy(*within).orderBy(order))
    running = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("n"))
    return running.withColumns(
        {"_k0": F.expr("(_before * _n) div _total + 1"), "_k1": F.expr("(_upto * _n) div _total")}
    ).filter("_k0 <= _k1")
