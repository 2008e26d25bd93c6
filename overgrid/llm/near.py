"""MinHash near-dedup with HyperMinHash sketches.

A text's words are runs of other than ASCII white space, ``A-Z`` lower-cased; its set is its distinct shingles of
five words (the whole sequence as one, where there are fewer).  Each of 120 buckets keeps the smallest of its own
hashes of the set as the count of leading zeros and ten bits of mantissa, 16 bits in all.  Runs of registers are the
bands, as wide as the threshold allows: 24 of five, which texts with Jaccard likeness 0.85 all miss with chance 1e-6,
or 30 of four, with chance 2e-7 at 0.8.  Texts that share a band go to exact
linking, where the collision-corrected estimate from the registers rules out far candidates before full sets are
compared (at five standard errors below the threshold).

Null and empty texts and texts without words have an empty set and are linked with nothing.  Rows with a null id are
linked with nothing either, and kept, with a null component.  Rows that repeat an id are linked like others.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overgrid.llm import linking
from overgrid.llm.common import free_name, plain, shared_folder, stored
from overgrid.llm.linking import components, link, star_edges
from overgrid.llm.words import U, minima, mix, shingle_sets
from overgrid.operators.joins import fan_join

PERCENT = 85
REGISTERS = 120
#: Chance at most that two texts as like as the threshold share no band.
MISS = 2e-6
MANTISSA = 10


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros in the high six bits, mantissa in the low ten."""
    fraction, exponent = np.frexp(np.maximum(least, U(1)).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return zeros << np.uint16(MANTISSA) | mantissa


def band_width(percent: int = PERCENT) -> int:
    """The most registers a band with which texts of this likeness miss all bands with chance ``MISS`` at most."""
    return max((w for w in range(1, REGISTERS + 1) if REGISTERS % w == 0 and (1 - (percent / 100) ** w) ** (REGISTERS // w) <= MISS), default=1)


def band_keys(table: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """``(sets, bands)``: a hash of each band's registers and number."""
    width = band_width(percent)
    bands = REGISTERS // width
    parts = table.reshape(len(table), bands, width).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(table), bands)) + U(1)
    for k in range(width):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard likeness from registers, corrected for equal registers of different minima."""
    chance = 2.0**-MANTISSA / 3
    return np.maximum(0.0, ((a == b).mean(axis=-1) - chance) / (1 - chance))


def likeness(sketches: list[bytes], percent: int = PERCENT) -> Callable[[int, np.ndarray], np.ndarray]:
    """A test that rules out candidates whose estimate is five standard errors below the threshold."""
    table = np.stack([np.frombuffer(s, dtype=np.uint16) for s in sketches])
    p = percent / 100
    least = p - 5 * np.sqrt(p * (1 - p) / REGISTERS)
    return lambda x, others: estimate(table[x], table[others]) >= least


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, digest, sketch)`` from ``(doc_id, text)``; digest and sketch are null for an empty set."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 512):
                yield sketched(part.iloc[at : at + 512])

    def sketched(part: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingle_sets(part["text"].tolist()))
        full = [i for i, s in enumerate(sets) if len(s)]
        digest: list[bytes | None] = [None] * len(sets)
        sketch: list[bytes | None] = [None] * len(sets)
        if full:
            for i, row in zip(full, registers(minima([sets[i] for i in full], REGISTERS)), strict=True):
                digest[i] = linking.digest(sets[i])
                sketch[i] = row.tobytes()
        return pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "size": [len(s) for s in sets], "digest": digest, "sketch": sketch})

    return docs.mapInPandas(run, "doc_id long, size long, digest binary, sketch binary")


def band_rows(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(key, id)``: the bands of each item."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                table = np.stack([np.frombuffer(s, dtype=np.uint16) for s in part["sketch"]])
                keys = band_keys(table, percent)
                yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "id": part["id"].repeat(keys.shape[1]).to_numpy()})

    return items.select("id", "sketch").mapInPandas(run, "key long, id binary")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``."""
    folder = shared_folder(docs.sparkSession)
    named = plain(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    drawn = stored(sketches(named), "sketches", folder)
    usable = drawn.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    items = stored(
        usable.groupBy(F.col("digest").alias("id")).agg(
            F.min("doc_id").alias("first"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch")
        ),
        "items", folder,
    )
    coarse = stored(components(star_edges(band_rows(items, percent)), folder, "coarse"), "groups", folder)
    members = items.join(coarse, "id").select("root", "id", "first", "size", "sketch")
    groups = named.join(members.withColumnRenamed("first", "doc_id"), "doc_id")
    linked = link(groups, shingle_sets, percent, folder, partial(likeness, percent=percent))
    classes = items.select("id", "first").join(linked, "id")
    named_classes = classes.groupBy("root").agg(F.min("first").alias("component"))
    lookup = stored(fan_join(classes, named_classes, ["root"]).select("id", "component"), "classes", folder)
    own = items.select("id", "first").join(lookup, "id", "left").select(F.col("id").alias("digest"), F.coalesce("component", "first").alias("_c"))
    own = stored(own, "own", folder)
    joined = fan_join(drawn.drop("sketch"), own, ["digest"], "left")
    component = F.when(F.col("digest").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("_c"))
    return joined.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.  Columns stay as they are."""
    lost = near_components(docs, percent=percent).filter("NOT kept").select("doc_id").distinct()
    name = free_name(docs.columns, "_lost")
    return docs.join(lost.withColumnRenamed("doc_id", name), F.col("doc_id") == F.col(name), "left_anti")


def op7_near_dedup(spark, sf: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf}/documents.parquet"))
