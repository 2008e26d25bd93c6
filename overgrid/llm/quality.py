"""Quality classifier: Bradley-Terry pairwise ranking.

Each labelled document is a player with a latent score ``w . x``; the chance that a good document beats a bad one
is the logistic of the difference.  The weights are learnt by logistic loss on feature differences of (good, bad)
pairs.  A quantile of the training scores is the threshold; scores are mapped to 0..1 so that it falls on 0.3.

Features come from the whole text alone.  Null and empty texts have a score like any other.  Labels of null, of
several different values for one document, or of other values than 0 and 1 are left out.  Without both labels in
the training rows every document scores 0.5 (nothing is rejected).  Documents with a null id are never training
rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overgrid.llm.common import free_name, plain, sampled

#: Documented bound: labelled rows that the model is fitted on (picked by a hash of the id), and pairs drawn.
MAX_TRAINING_ROWS = 6000
PAIRS = 40_000
CUT = 0.3
BIGRAMS = 512
ENDS = re.compile(r"[^\W_]+([^\w\s]+)(?=\s|$)")


def features(texts: list[str | None]) -> np.ndarray:
    """One row of numbers per text: byte shares, hashed byte pairs, repetition and word shape."""
    out = np.zeros((len(texts), 128 + BIGRAMS + 14), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        text = text or ""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        n = len(data)
        if not n:
            row[-1] = 1
            continue
        counts = np.bincount(data, minlength=256)
        row[:128] = np.sqrt(counts[:128] / n)
        pairs = (data[:-1].astype(np.uint32) * 0x9E3B + data[1:].astype(np.uint32) * 0x85F1) >> 3
        row[128 : 128 + BIGRAMS] = np.sqrt(np.bincount(pairs % BIGRAMS, minlength=BIGRAMS) / n)
        row[128 + BIGRAMS :] = _shape(text, counts, n)
    return out


def _shape(text: str, counts: np.ndarray, n: int) -> list[float]:
    words = text.split()
    total = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split("\n")
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    punctuation = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    return [
        len(set(words)) / total,
        again / total,
        pairs / total,
        len(set(lines)) / len(lines),
        min(20.0, len(text) / total) / 20,
        np.log1p(len(words)) / 10,
        np.log1p(len(lines)) / 5,
        upper / n,
        upper / max(1, upper + lower),
        punctuation / n,
        float(punctuation / total > 0.5),
        counts[128:].sum() / n,
        counts[48:58].sum() / n,
        0.0,
    ]


@dataclass(frozen=True)
class Ranking:
    """Weights over standardised features, and the line that maps a latent score to the log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float64) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = (self.latent(x) - self.threshold) * self.slope + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7) -> Ranking | None:
    """Bradley-Terry weights from rows and their 0/1 labels; None without rows of both kinds."""
    if good.all() or not good.any():
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-2
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float64)
    random = np.random.default_rng(seed)
    first = random.choice(np.flatnonzero(good), PAIRS)
    second = random.choice(np.flatnonzero(~good), PAIRS)
    weights, step, square = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, 301):
        pairs = random.integers(0, PAIRS, 4096)
        batch = z[first[pairs]] - z[second[pairs]]
        lost = 1 / (1 + np.exp(np.clip(batch @ weights, -40, 40)))
        gradient = -(batch * lost[:, None]).mean(0) + 2e-3 * weights
        step, square = 0.9 * step + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weights -= 0.02 * (step / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    latent = z @ weights
    return Ranking(mean, scale, weights, *_threshold(latent, good))


def _threshold(latent: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """The lowest quantile of the training scores that parts the labels about as well as the best one (a good
    document lost weighs more than a bad one kept), and the slope of the logistic there."""
    levels = np.quantile(latent, np.linspace(0, 1, 513))
    cuts = (levels[:-1] + levels[1:]) / 2
    right = [(latent[good] >= c).mean() + (latent[~good] < c).mean() for c in cuts]
    cut = float(cuts[np.flatnonzero(np.array(right) >= max(right) - 2e-3)[0]])
    gap = max(1e-3, np.median(latent[good]) - np.median(latent[~good]))
    return cut, float(6 / gap)


def training_ids(labels: DataFrame, bound: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``(id, good)`` of at most about ``bound`` labelled documents outside the held-out fifth, picked by hash."""
    named = plain(labels, id="doc_id", label="quality").filter("id IS NOT NULL AND label IN (0, 1)")
    clean = (
        named.filter(~held_out("id"))
        .groupBy("id")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low = high")
    )
    total = clean.count()
    share = sampled(F.col("id"), bound, total)
    return clean.filter(share).select("id", (F.col("low") == 1).alias("good"))


def held_out(column: str) -> Column:
    """Whether crc32 of the id as text leaves no remainder modulo 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@F.pandas_udf(T.BinaryType())
def _features(text: pd.Series) -> pd.Series:
    """Rows of numbers as bytes: the driver holds them without an object for each number."""
    return pd.Series([row.tobytes() for row in features(text.tolist())], dtype=object)


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAINING_ROWS) -> Ranking | None:
    """Fit on a bounded sample of labelled documents; the features are made on the executors."""
    chosen = F.broadcast(training_ids(labels, bound))  # at most about ``bound`` rows of 9 bytes
    rows = plain(docs, id="doc_id", text="text").join(chosen, "id").select("good", _features("text").alias("x"))
    found = rows.toPandas()
    if found.empty:
        return None
    x = np.stack([np.frombuffer(row, dtype=np.float32) for row in found["x"]])
    return fit(x, found["good"].to_numpy(dtype=bool))


def score(docs: DataFrame, model: Ranking | None, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(features(texts.tolist())))

    return docs.withColumn(column, scored(F.col(f"`{text}`")))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score at least 0.3, with the columns they came with."""
    name = free_name(docs.columns, "_quality")
    return score(docs, train(docs, labels), name).filter(F.col(name) >= CUT).drop(name)


def op10_quality(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
