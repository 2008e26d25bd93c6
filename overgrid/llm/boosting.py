"""Gradient-boosted trees for two classes: logistic loss, splits at quantiles of the training rows.

The same trees grow from rows in memory (``fit``) and from a table of any size (``fit_table``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overgrid.llm.common import stored

DEPTH, ROUNDS, RATE, BINS, PENALTY = 3, 60, 0.2, 16, 1.0
#: Gradients are summed as whole numbers of this many to one; the bin that stands for no cut.
STEPS, NO_CUT = 1 << 20, BINS


@dataclass(frozen=True)
class Trees:
    """Full binary trees of one depth: split features, cuts and leaf values."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    start: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
            total += leaves[node - (2**DEPTH - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees from rows and their 0/1 labels; both labels must occur."""
    levels = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins, n = places(x, levels), np.ones(len(y))
    return _grow(levels, float(y.mean()), lambda *grown: _tally(bins, y, n, *grown))


def fit_table(rows: DataFrame) -> Trees:
    """Trees from all rows ``(x array<double>, good boolean, n bigint)``, each of which counts ``n`` times.

    Quantiles are exact.  Rows are told by the bins of their features and written once; each depth of each tree is one
    pass of Spark over them, which brings the driver one sum for a node, feature and bin.  Sums are of whole numbers,
    so the trees do not depend on how rows are dealt out.
    """
    counts = rows.select(F.posexplode("x").alias("j", "v"), "n").groupBy("j", "v").agg(F.sum("n").alias("n"))
    shares = ", ".join(repr(i / BINS) for i in range(1, BINS))
    told = {r.j: r.cuts for r in counts.groupBy("j").agg(F.expr(f"percentile(v, array({shares}), n)").alias("cuts")).collect()}
    levels = [np.unique(np.array(told[j], dtype=float)) for j in sorted(told)]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                bins = places(np.array(part["x"].tolist()), levels)
                yield pd.DataFrame({"bins": [b.tobytes() for b in bins], "good": part["good"], "n": part["n"]})

    placed = rows.select("x", "good", "n").mapInPandas(place, "bins binary, good boolean, n bigint")
    table = stored(placed.groupBy("bins", "good").agg(F.sum("n").alias("n")), "binned")
    both = table.agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("n")).first()

    def tally(*grown) -> np.ndarray:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((0, 3), dtype=np.int64)
            for part in parts:
                if len(part):
                    bins = np.frombuffer(b"".join(part["bins"]), dtype=np.uint8).reshape(len(part), -1)
                    sums = _tally(bins, part["good"].to_numpy(dtype=float), part["n"].to_numpy(dtype=float), *grown)
                    total = sums if not len(total) else total + sums
            at = np.flatnonzero(total[:, 2])
            yield pd.DataFrame({"at": at, "g": total[at, 0], "h": total[at, 1], "n": total[at, 2]})

        sums = table.mapInPandas(run, "at bigint, g bigint, h bigint, n bigint").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        out = np.zeros((2 ** grown[-1] * len(levels) * BINS, 3), dtype=np.int64)
        for r in sums.collect():
            out[r["at"]] = r.g, r.h, r.n
        return out

    return _grow(levels, both.good / both.n, tally)


def places(x: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The bin of every feature: how many of its cuts lie below."""
    return np.stack([np.searchsorted(cuts, x[:, j], side="left") for j, cuts in enumerate(levels)], 1).astype(np.uint8)


def _walk(bins: np.ndarray, features: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    for _ in range(depth):
        node = 2 * node + 1 + (bins[rows, features[node]] > cuts[node])
    return node - (2**depth - 1)


def _tally(bins: np.ndarray, y: np.ndarray, n: np.ndarray, start: float, trees: list, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Gradients, weights (both in steps) and rows by node of the open tree, feature and bin."""
    odds = np.full(len(y), start)
    for features, cuts, leaves in trees:
        odds += leaves[_walk(bins, features, cuts, DEPTH)]
    chance, width = 1 / (1 + np.exp(-odds)), bins.shape[1]
    sums = np.rint(n * (y - chance) * STEPS), np.rint(n * chance * (1 - chance) * STEPS), n
    at = ((_walk(bins, feature, cut, depth)[:, None] * width + np.arange(width)) * BINS + bins).ravel()
    return np.stack([np.bincount(at, np.repeat(v, width), 2**depth * width * BINS) for v in sums], 1).astype(np.int64)


def _grow(levels: list[np.ndarray], share: float, tally: Callable[..., np.ndarray]) -> Trees:
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    trees: list = []
    for _ in range(ROUNDS):
        feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, NO_CUT)
        sides: list = []
        for depth in range(DEPTH):
            sums = tally(start, trees, feature, cut, depth).reshape(2**depth, len(levels), BINS, 3)
            sides = []
            for i, of_node in enumerate(sums):
                n = 2**depth - 1 + i
                feature[n], cut[n] = _split(of_node, levels)
                low = of_node[feature[n], : cut[n] + 1].sum(axis=0)
                sides += [low, of_node[feature[n]].sum(axis=0) - low]
        g, h = np.array(sides)[:, 0] / STEPS, np.array(sides)[:, 1] / STEPS
        trees.append((feature, cut, RATE * g / (h + PENALTY)))
    values = [np.array([levels[j][c] if c < NO_CUT else np.inf for j, c in zip(f, k, strict=True)]) for f, k, _ in trees]
    return Trees(np.array([t[0] for t in trees]), np.array(values), np.array([t[2] for t in trees]), start)


def _split(sums: np.ndarray, levels: list[np.ndarray]) -> tuple[int, int]:
    """The feature and cut of the greatest gain, or a cut that sends all rows left."""
    best = (1e-9, 0, NO_CUT)
    g, h, n = sums[0].sum(axis=0)
    if n < 8:
        return 0, NO_CUT
    g, h = g / STEPS, h / STEPS
    for j, cuts in enumerate(levels):
        if not len(cuts):
            continue
        low = np.cumsum(sums[j], axis=0)[: len(cuts)]
        low_g, low_h = low[:, 0] / STEPS, low[:, 1] / STEPS
        gain = low_g**2 / (low_h + PENALTY) + (g - low_g) ** 2 / (h - low_h + PENALTY) - g**2 / (h + PENALTY)
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), j, at)
    return best[1], best[2]
