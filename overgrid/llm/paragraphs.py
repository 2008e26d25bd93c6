"""Substring dedup: paragraphs that repeat across documents, exactly or nearly.

A paragraph is a line of a text with at least ``MIN_WORDS`` words.  Its set is its distinct shingles of five words
(``A-Z`` lower-cased).  Paragraphs with equal sets are one item.  Items are MinHashed; the number of rows a band is
tuned so that two items with Jaccard likeness 0.8 share a band with chance ``RECALL`` at least.  Colliding items are
joined, linked if 100 |A & B| >= 80 |A | B| on full sets, and clustered by connected components.  Of a cluster that
two documents or more hold, the first paragraph (smallest document, then place) stays and the others are removals.

What lines cannot show, ``passages`` finds: verbatim passages inside, across and over lines.  ``op4_passages`` and
``substring_dedup`` take both.

Null and empty texts have no paragraphs.  Rows with a null id are passed over.  Rows that repeat an id are one
document.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overgrid.llm import passages
from overgrid.llm.collocations import bloom, combine, known
from overgrid.llm.common import free_name, plain, shared_folder, stored
from overgrid.llm.linking import components, digest, link, tied_edges
from overgrid.llm.words import U, minima, mix, shingle_sets
from overgrid.operators.joins import fan_join

MIN_WORDS, PERCENT = 20, 80
HASHES, RECALL = 64, 0.9995


def tuned_rows(likeness: float, hashes: int = HASHES, recall: float = RECALL) -> int:
    """The most rows a band for which ``hashes // rows`` bands find pairs of this likeness with this chance."""
    return max((r for r in range(1, hashes + 1) if 1 - (1 - likeness**r) ** (hashes // r) >= recall), default=1)


ROWS = tuned_rows(PERCENT / 100)


def band_keys(sets: list[np.ndarray], rows: int = ROWS) -> np.ndarray:
    """``(sets, bands)``: a hash of each band's minima and number."""
    bands = HASHES // rows
    parts = minima(sets, bands * rows).reshape(len(sets), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands))
    for k in range(rows):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def long_lines(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, str]]:
    lines = (text or "").split("\n")
    return [(i, line) for i, line in enumerate(lines) if len(line) >= 2 * min_words - 1 and len(line.split()) >= min_words]


PARAGRAPH = "doc_id long, paragraph int, id binary, size long, keys array<long>"


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, keyed: bool = True) -> DataFrame:
    """``PARAGRAPH``: every paragraph's set, named by its digest, with its size and (``keyed``) band keys."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                few = part.iloc[at : at + 256]
                found = [(d, i, line) for d, text in zip(few["doc_id"], few["text"], strict=True) for i, line in long_lines(text, min_words)]
                sets = list(shingle_sets([line for _, _, line in found]))
                held = [k for k, s in enumerate(sets) if len(s)]
                if not held:
                    continue
                keys = band_keys([sets[k] for k in held]).view(np.int64) if keyed else [None] * len(held)
                rows = {"doc_id": [found[k][0] for k in held], "paragraph": [found[k][1] for k in held], "id": [digest(sets[k]) for k in held]}
                yield pd.DataFrame(rows | {"size": [len(sets[k]) for k in held], "keys": list(keys)})

    return docs.mapInPandas(run, PARAGRAPH)


def place_keys(doc_id: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    return combine(doc_id.astype(np.int64).view(np.uint64), paragraph.astype(np.uint64))


@F.pandas_udf(T.LongType())
def _place(doc_id: pd.Series, paragraph: pd.Series) -> pd.Series:
    return pd.Series(place_keys(doc_id.to_numpy(), paragraph.to_numpy()).view(np.int64))


def wanted_lines(docs: DataFrame, wanted, min_words: int) -> DataFrame:
    """``(doc_id, paragraph, text)``: the paragraphs whose places the filter ``wanted`` may hold."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                few = part.iloc[at : at + 256]
                found = [(d, i, line) for d, text in zip(few["doc_id"], few["text"], strict=True) for i, line in long_lines(text, min_words)]
                if found:
                    rows = pd.DataFrame(found, columns=["doc_id", "paragraph", "text"])
                    yield rows[known(wanted.value, place_keys(rows["doc_id"].to_numpy(), rows["paragraph"].to_numpy()))]

    return docs.mapInPandas(run, "doc_id long, paragraph int, text string")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, paragraph, first_doc_id, first_paragraph, kept)`` of the paragraphs of clusters over documents."""
    folder = shared_folder(docs.sparkSession)
    named = plain(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    found = stored(paragraphs(named, min_words, keyed=False).select("doc_id", "paragraph", "id"), "paragraphs", folder)
    # Band keys are made anew here rather than written for every copy of a paragraph.
    items = stored(
        paragraphs(named, min_words).groupBy("id").agg(
            F.min(F.struct("doc_id", "paragraph")).alias("first"), F.max("doc_id").alias("last"),
            F.any_value("size").alias("size"), F.any_value("keys").alias("keys"),
        ),
        "paragraph-items", folder,
    )
    # Coarse groups go by 64 bits of the items' names: two items of one short name only share a coarse group.
    short = items.select("id", "first", "size", "keys", F.xxhash64("id").alias("short"))
    edges = tied_edges(short.select(F.explode("keys").alias("key"), F.col("short").alias("id")), folder)
    coarse = stored(components(edges, folder, "coarse").withColumnRenamed("id", "short"), "groups", folder)
    root = F.encode(F.col("root").cast("string"), "utf-8").alias("root")
    members = stored(short.join(coarse, "short").select(root, "id", "size", "first.doc_id", "first.paragraph"), "paragraph-members", folder)
    # Few lines are members: a filter finds them where they are, so that lines move and not texts.
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(members.select(_place("doc_id", "paragraph").alias("key")), members.count()))
    lines = wanted_lines(named, wanted, min_words).join(members, ["doc_id", "paragraph"])
    groups = stored(lines.select("root", "id", "size", "text", F.lit(None).cast("binary").alias("sketch")), "paragraph-groups", folder)
    wanted.unpersist()
    linked = link(groups, shingle_sets, PERCENT, folder)
    rooted = items.select("id", "first", "last").join(linked, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = stored(rooted, "rooted", folder)
    clusters = rooted.groupBy("root").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first.doc_id < last")
    clusters = stored(clusters.select("root", "first"), "clusters", folder)
    classes = stored(fan_join(rooted.select("root", "id"), clusters, ["root"]).select("id", "first"), "paragraph-classes", folder)
    return fan_join(found.select("doc_id", "paragraph", "id"), classes, ["id"]).select(
        "doc_id", "paragraph", F.col("first.doc_id").alias("first_doc_id"), F.col("first.paragraph").alias("first_paragraph"),
        ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("paragraph") == F.col("first.paragraph"))).alias("kept"),
    ).distinct()


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, gone: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([passages.cut(*row) for row in zip(text, gone, words, strict=True)], dtype=object)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the paragraphs and passages that an earlier place holds; columns stay as they are."""
    name, doc, text, lines, words = (free_name(docs.columns, c) for c in ("_gone", "_doc", "_text", "_lines", "_words"))
    gone = repeated(docs).filter("NOT kept").groupBy("doc_id").agg(F.collect_set("paragraph").alias(lines)).withColumnRenamed("doc_id", name)
    spans = passages.spans(docs).groupBy("doc_id", "text_id").agg(F.collect_set(F.array("first_word", "words")).alias(words))
    spans = spans.withColumnsRenamed({"doc_id": doc, "text_id": text})
    joined = docs.join(gone, F.col("doc_id") == F.col(name), "left")
    joined = joined.join(spans, (F.col("doc_id") == F.col(doc)) & (passages.text_name("text") == F.col(text)), "left")
    return joined.withColumn("text", _without("text", F.col(lines), F.col(words))).select(*docs.columns)


def op4_paragraphs(spark, sf: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{sf}/documents.parquet"))


def op4_passages(spark, sf: str) -> DataFrame:
    """The whole job: the rows of ``op4_paragraphs``, and the passages, whose ``paragraph`` is null."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return repeated(docs).unionByName(passages.passages(docs), allowMissingColumns=True)
