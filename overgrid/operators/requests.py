"""Tables of requests: comma lists of layers and weights, as a client sends them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layer_weight_pairs(requests: DataFrame, strict: bool = False) -> DataFrame:
    """Split ``layers`` and ``weights`` and pair them by position, cut to the shorter list.

    Empty entries at a list's end do not count.  A weight that is no integer, or has blanks around it, is NULL, or an
    error with ``strict``.  The lists sit in one row, so they are
    paired inside it: no join and no shuffle.
    """
    rest = [c for c in requests.columns if c not in ("layers", "weights")]
    names, numbers = _entries("layers"), _entries("weights")
    pairs = F.slice(F.arrays_zip(names.alias("layer"), numbers.alias("weight")), 1, F.least(F.size(names), F.size(numbers)))
    out = requests.select(*rest, F.posexplode(pairs).alias("pos", "pair"))
    whole = F.col("pair.weight").rlike(r"^[+-]?[0-9]+$")
    number = F.when(whole, F.col("pair.weight"))
    if strict:
        number = F.when(whole, F.col("pair.weight")).otherwise(F.raise_error(F.concat(F.lit("no integer weight: "), F.col("pair.weight"))))
    weight = number.cast("int") if strict else number.try_cast("int")
    return out.select(*rest, "pos", F.col("pair.layer").alias("layer"), weight.alias("weight"))


def weighed_layers(layers: str = "layers", weights: str = "weights") -> Column:
    """The pairs of two comma lists as one sorted array of ``(layer, weight)``; weights that are no number are left out."""
    names, numbers = _entries(layers), _entries(weights)
    pairs = F.slice(F.arrays_zip(names.alias("layer"), numbers.alias("weight")), 1, F.least(F.size(names), F.size(numbers)))
    whole = F.transform(
        pairs, lambda p: F.struct(p["layer"].alias("layer"), F.when(p["weight"].rlike(r"^[+-]?[0-9]+$"), p["weight"]).try_cast("int").alias("weight"))
    )
    kept = F.filter(whole, lambda p: p["weight"].isNotNull())
    return F.array_sort(F.coalesce(kept, F.array().cast("array<struct<layer:string,weight:int>>")))


def _entries(column: str) -> Column:
    """A comma list without the empty entries at its end; a list of commas alone has none."""
    cut = F.regexp_replace(column, ",+$", "")
    return F.when((cut == "") & (F.col(column) != ""), F.array().cast("array<string>")).otherwise(F.split(cut, ","))


def active_layers(pairs: DataFrame, by: str) -> DataFrame:
    """Per request, the layers of non-zero weight, joined to comma lists in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "layer", "weight")))
    kept = pairs.filter(F.col("weight") != 0).groupBy(by).agg(ordered.alias("kept"))
    return kept.select(
        by,
        F.array_join(F.transform("kept", lambda k: k["layer"]), ",").alias("layers"),
        F.array_join(F.transform("kept", lambda k: k["weight"].cast("string")), ",").alias("weights"),
    )


def weight_label(weight: Column) -> Column:
    return F.when(weight > 0, F.concat(F.lit("+"), weight.cast("string"))).otherwise(weight.cast("string"))
