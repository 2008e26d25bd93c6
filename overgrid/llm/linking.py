"""Similarity classes of sets of shingles: shared by the near-duplicate operators.

Items are distinct sets, named by a digest, so exact copies are one item before any pair is thought of.  Items that
share a band key become *coarse* groups (star edges to the smallest item of a key, then connected components).
A coarse group of bounded size is linked exactly inside one task; a larger one is linked by joins: its most typical
item is compared with all, and what is left probes the others with its rarest shingles.  No step lists the pairs of
a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overgrid.llm.common import partitions, stored
from overgrid.operators.joins import fan_join

#: A coarse group with more items or more shingles than this is linked by joins, not inside one task.
GROUP_ITEMS = 20_000
GROUP_SHINGLES = 4_000_000
#: Characters of text from which on a task links the groups that it holds.
LINKED_AT_ONCE = 200_000
SALTS = 32
#: Rounds of contraction, whose number grows with the logarithm of the edges; more are an error.
ROUNDS = 100


def digest(shingles: np.ndarray) -> bytes:
    """The name of a set: 128 bits of its sorted shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def star_edges(keys: DataFrame) -> DataFrame:
    """``(key, id)`` to edges ``(a, b)``, b < a, that connect the items of every key.

    Each key is cut in parts by a hash of the item; the smallest items of the parts meet in a second round, so one
    key with a third of all items is no single group.
    """
    salted = keys.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = salted.withColumn("_m", F.min("id").over(Window.partitionBy("key", "_s")))
    heads = salted.groupBy("key", "_s").agg(F.min("id").alias("id"))
    second = heads.withColumn("_m", F.min("id").over(Window.partitionBy("key")))
    both = first.select("id", "_m").unionByName(second.select("id", "_m"))
    return both.filter("id > _m").select(F.col("id").alias("a"), F.col("_m").alias("b")).distinct()


def tied_edges(keys: DataFrame, folder: str) -> DataFrame:
    """``star_edges`` for many keys of which few have two items: only those that do are joined with their items.

    The smallest item of each key is an aggregate with map-side partials, and the join with the written keys is one
    that Spark splits where a key is hot.
    """
    least = keys.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    tied = stored(least.select("key", "b"), "tied", folder)
    return keys.join(tied, "key").filter("id > b").select(F.col("id").alias("a"), "b").distinct()


def components(edges: DataFrame, folder: str, name: str = "cc") -> DataFrame:
    """``(id, root)`` of every item on an edge ``(a, b)``: root is the smallest item that it is connected with.

    Alternating star contraction: neighbours are hung on the smallest neighbour until nothing changes.  Every round
    is written to the shared folder.
    """
    now, before = stored(_oriented(edges), f"{name}-0", folder), None
    for k in range(1, ROUNDS + 1):
        mark = _checksum(now)
        if mark == before:
            break
        before = mark
        now = stored(_small_star(_large_star(now)), f"{name}-{k}", folder)
    else:
        raise RuntimeError(f"components still change after {ROUNDS} rounds")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is hung on the node's smallest neighbour (or the node itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
    joined = fan_join(both.filter("b > a"), least, ["a"])
    return joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    down = _oriented(edges)
    least = down.groupBy("a").agg(F.min("b").alias("_m"))
    joined = fan_join(down, least, ["a"]).select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b")
    return joined.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def link_group(sets: list[np.ndarray], percent: int, likeness: Callable[[int, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The class of each set (the index of its first member), linking sets with 100 |A & B| >= percent |A | B|.

    The set of the commonest shingles is compared with all others first.  Every set that it doesn't link is looked
    up by its rarest shingles: of a set of n, any n - ceil(percent n / 100) + 1 must meet each set it is linked
    with.  So no link is lost.  ``likeness`` may rule out candidates by an estimate.
    """
    count, root = len(sets), np.arange(len(sets))
    if count < 2:
        return root
    if count == 2:
        both = np.sort(np.concatenate(sets))
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        return np.zeros_like(root) if 100 * shared >= percent * (len(both) - shared) else root
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    frequency = np.bincount(ids)
    order = np.argsort(ids, kind="stable")
    holders = owner[order]
    bounds = np.zeros(len(frequency) + 1, dtype=np.int64)
    np.cumsum(frequency, out=bounds[1:])
    sizes = np.array([len(s) for s in sets])
    cuts = np.zeros(count + 1, dtype=np.int64)
    np.cumsum(sizes, out=cuts[1:])
    own = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def postings(shingles: np.ndarray) -> np.ndarray:
        lengths = frequency[shingles]
        ends = np.cumsum(lengths)
        at = np.repeat(bounds[shingles] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return holders[at]

    def merge(x: int, others: np.ndarray) -> None:
        roots = np.unique(root[np.append(others, x)])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]

    def linked(x: int, among: np.ndarray | None) -> np.ndarray:
        shared = np.bincount(postings(own[x]), minlength=count)
        fits = 100 * shared >= percent * (sizes[x] + sizes - shared)
        fits[x] = False
        if among is not None:
            chosen = np.zeros(count, dtype=bool)
            chosen[among] = True
            fits &= chosen
        return np.flatnonzero(fits)

    weight = np.bincount(owner, weights=np.minimum(frequency, count)[ids], minlength=count) / np.maximum(1, sizes)
    leader = int(np.argmax(weight))
    merge(leader, linked(leader, None))
    done = root == root[leader]
    for x in np.flatnonzero(~done):
        shingles = own[x][np.argsort(frequency[own[x]], kind="stable")]
        prefix = shingles[: len(shingles) + (-percent * len(shingles) // 100) + 1]
        met = np.unique(postings(prefix[frequency[prefix] > 1]))
        met = met[(root[met] != root[x]) & (100 * np.minimum(sizes[met], sizes[x]) >= percent * np.maximum(sizes[met], sizes[x]))]
        if len(met) and likeness is not None:
            met = met[likeness(int(x), met)]
        if len(met):
            merge(int(x), linked(int(x), met))
    return root


def link(
    groups: DataFrame,
    sets_of: Callable[[list[str]], Iterator[np.ndarray]],
    percent: int,
    folder: str,
    likeness: Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]] | None = None,
    most: tuple[int, int] = (GROUP_ITEMS, GROUP_SHINGLES),
) -> DataFrame:
    """``(id, root)`` of the items of coarse groups ``(root, id, size, text, sketch)`` that have a link.

    Texts whose set is not the item's (other texts of one document id) are passed over.
    """
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("shingles"))
    sizes = sizes.withColumn("small", (F.col("items") <= most[0]) & (F.col("shingles") <= most[1]))
    sizes = stored(sizes.select("root", "small"), "group-sizes", folder)
    held = groups.join(sizes.filter("small").select("root"), "root")
    near = stored(_link_small(held, sets_of, percent, likeness), "small-links", folder)
    giant = sizes.filter("NOT small").select("root")
    if giant.isEmpty():
        return near
    return near.unionByName(_link_giant(fan_join(groups, giant, ["root"]), sets_of, percent, folder))


def _link_small(held: DataFrame, sets_of, percent: int, likeness) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; one group of bounded size is held at a time, or more that are small."""
        rows, size = [], 0
        for part in parts:
            for row in part[["root", "id", "text", "sketch"]].itertuples(index=False, name=None):
                if size >= LINKED_AT_ONCE and row[0] != rows[-1][0]:
                    yield link_rows(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2] or "")
        if rows:
            yield link_rows(rows)

    def link_rows(rows: list) -> pd.DataFrame:
        sets = sets_of([text for _, _, text, _ in rows])
        own = [(root, bytes(name), sketch, s) for (root, name, _, sketch), s in zip(rows, sets, strict=True) if digest(s) == bytes(name)]
        found = []
        for _, group in groupby(own, key=lambda row: row[0]):
            _, names, sketches, sets = zip(*group, strict=True)
            roots = link_group(list(sets), percent, likeness(list(sketches)) if likeness else None)
            for r in _shared(roots):
                members = [names[i] for i in np.flatnonzero(roots == r)]
                least = min(members)
                found.extend((name, least) for name in members)
        return pd.DataFrame(found, columns=["id", "root"])

    n = partitions(held.sparkSession)
    spread = held.select("root", "id", "text", "sketch").repartition(n, "root").sortWithinPartitions("root", "id")
    return spread.mapInPandas(run, "id binary, root binary")


def _shared(roots: np.ndarray) -> np.ndarray:
    found, count = np.unique(roots, return_counts=True)
    return found[count > 1]


def _link_giant(groups: DataFrame, sets_of, percent: int, folder: str) -> DataFrame:
    """Linking by joins on (group, shingle), for groups that no task may hold."""

    def explode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                few = part.iloc[at : at + 256]
                sets = list(sets_of(few["text"].tolist()))
                own = [digest(s) == bytes(name) for s, name in zip(sets, few["id"], strict=True)]
                few, sets = few[own], [s for s, is_own in zip(sets, own, strict=True) if is_own]
                if not sets:
                    continue
                lengths = [len(s) for s in sets]
                yield pd.DataFrame(
                    {
                        "root": few["root"].repeat(lengths).to_numpy(),
                        "id": few["id"].repeat(lengths).to_numpy(),
                        "h": np.concatenate(sets).view(np.int64),
                    }
                )

    exploded = groups.select("root", "id", "text").mapInPandas(explode, "root binary, id binary, h long")
    rows = stored(exploded.distinct(), "giant-rows", folder)
    sizes = stored(rows.groupBy("root", "id").agg(F.count(F.lit(1)).alias("n")), "giant-sizes", folder)
    common = stored(rows.groupBy("root", "h").agg(F.count(F.lit(1)).alias("df")), "giant-df", folder)
    counted = stored(fan_join(rows, common, ["root", "h"]), "giant-counted", folder)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Exact links among ``(root, x, y)``: the shared shingles are counted by a join on the x's own ones."""
        of_x = fan_join(rows.select("root", F.col("id").alias("x"), "h"), pairs.select("root", "x").distinct(), ["root", "x"])
        xs = pairs.join(of_x, ["root", "x"])
        shared = xs.join(rows.select("root", F.col("id").alias("y"), "h"), ["root", "y", "h"])
        shared = shared.groupBy("root", "x", "y").agg(F.count(F.lit(1)).alias("both"))
        a, b = sizes.select("root", F.col("id").alias("x"), F.col("n").alias("nx")), sizes.select("root", F.col("id").alias("y"), F.col("n").alias("ny"))
        both = fan_join(fan_join(shared, a, ["root", "x"]), b, ["root", "y"])
        fits = both.filter(F.expr(f"100 * both >= {percent} * (nx + ny - both)"))
        return stored(fits.select("root", F.col("x").alias("a"), F.col("y").alias("b")), name, folder)

    typical = counted.groupBy("root", "id").agg(F.avg("df").alias("w")).groupBy("root").agg(F.max_by("id", F.struct("w", "id")).alias("leader"))
    stars = sizes.join(typical, "root").filter("id <> leader").select("root", F.col("leader").alias("y"), F.col("id").alias("x"))
    star = verified(stars, "giant-star")
    settled = star.select("root", F.col("a").alias("id")).unionByName(star.select("root", F.col("b").alias("id"))).distinct()
    left = sizes.join(settled, ["root", "id"], "left_anti")
    by_rarity = Window.partitionBy("root", "id").orderBy("df", "h")
    prefix = (
        counted.join(left, ["root", "id"])
        .withColumn("_k", F.row_number().over(by_rarity))
        .filter(F.expr(f"_k <= n - ceil({percent} * n / 100) + 1 AND df > 1"))
    )
    met = prefix.select("root", F.col("id").alias("x"), "h").join(rows.select("root", F.col("id").alias("y"), "h"), ["root", "h"])
    probed = verified(met.filter("x <> y").select("root", "x", "y").distinct(), "giant-probes")
    edges = star.select("a", "b").unionByName(probed.select("a", "b"))
    return components(edges, folder, "giant-cc")
