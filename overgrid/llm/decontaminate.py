"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Items and documents are sequences of words (runs of letters, digits and non-ASCII bytes, ``A-Z`` lower-cased).  A
document holds an item of L words if some part of it is within floor(0.2 L) word edits of the item.

Every start of a document opens a window of each item length.  A window that could be within k edits of some item of
L words must keep at least L - 1 - 2k of the item's neighbouring word pairs; windows with fewer pairs known from items
of their length are passed over, which loses nothing.  The rest are embedded by random walks: at every step a walk writes
the word it stands on, and a random bit of step and word says whether it goes on, so words edits become few
differing places (Hamming distance).  Each of ``WALKS`` repetitions samples ``SAMPLES`` places as a key.  A window
that meets an item's key is verified by the exact edit distance of the item to the part of the document around it.

Windows at a document's end are cut there.  Items with fewer than five words match only exactly; items without words
and null texts match nothing; repeated items match alike; rows with null ids keep them.  Empty tables give empty
results.  The benchmark is read in blocks of at most ``BLOCK_WORDS`` words, one pass over the documents each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overgrid.llm.common import free_name, plain
from overgrid.llm.words import BASE, BASE_INVERSE, U, blocks, mix, powers, separators, word_hashes

EDITS_PERCENT = 20
#: Recall wanted at the full tolerance: 0.999.  Of plants with exactly floor(0.2 L) edits, 40 keys of 3 places found all
#: of 400 with substitutions and all of 400 with insertions and deletions too, where 20 keys of 4 found 0.90 to 0.91.
WALKS, SAMPLES = 40, 3
#: Walks that go on together.
WALKS_AT_ONCE = 10
BLOCK_WORDS = 1_000_000
#: Windows whose walks go on together.
AT_ONCE = 1024
PAD = U(0)
_STEP = 0x9E3779B97F4A7C15


def edits_allowed(n: np.ndarray | int) -> np.ndarray | int:
    return n * EDITS_PERCENT // 100


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; the last word stands alone."""
    after = np.append(words[1:], PAD)
    return mix(words * U(3) + after)


def walk_keys(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray, walks: slice = slice(None), seed: int = 11) -> np.ndarray:
    """``(walks, windows)`` LSH keys of the windows ``[start, end)`` taken as ``length`` words long.

    All walks of all windows go on together, one array operation a step.  A walk that runs past its end writes
    padding.  The sampled places are shares of twice the window's length, alike for equal lengths.
    """
    shares = np.sort(np.random.default_rng(seed).random((WALKS, SAMPLES)), axis=1)[walks]
    places = (shares[:, :, None] * (2 * lengths)[None, None, :]).astype(np.int64)
    at = np.broadcast_to(starts, (len(shares), len(starts))).copy()
    steps = int(places.max(initial=-1)) + 1
    salt = mix(np.arange(1, WALKS + 1, dtype=np.uint64))[walks, None] | U(1)
    padded = np.append(words, PAD)
    written = np.empty((steps, *at.shape), dtype=np.uint64)
    for step in range(steps):
        written[step] = padded[np.minimum(at, ends)] * (at < ends)
        turn = salt * U(pow(_STEP, step, 1 << 64))
        at += ((written[step] * turn) >> U(63)).astype(np.int64)
    keys = np.broadcast_to(lengths.astype(np.uint64), at.shape) * U(0xA0761D6478BD642F)
    for k in range(SAMPLES):
        keys = mix(keys + np.take_along_axis(written, places[None, :, k], 0)[0] * U(5))
    return keys


def edit_distance_within(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """``(edits, end)``: the least word edits between the item and any stretch of ``part``, and where it ends."""
    width = np.arange(len(part) + 1)
    row = np.zeros(len(part) + 1, dtype=np.int64)
    for i, word in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (part != word), row[1:] + 1)
        row = np.minimum.accumulate(best - width) + width
    end = int(np.argmin(row))
    return int(row[end]), end


@dataclass(frozen=True)
class Items:
    """One block of the benchmark, ready for look-up: words, known pairs and LSH keys."""

    ids: list
    words: np.ndarray
    bounds: np.ndarray
    pairs: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    owners: np.ndarray

    @staticmethod
    def build(ids: list, texts: list[str | None]) -> Items:
        separator = separators(keep_punctuation=False)
        parts = [word_hashes((t or "").encode("utf-8", "surrogatepass") + b"\n", separator)[2] for t in texts]
        kept = [(i, p) for i, p in zip(ids, parts, strict=True) if len(p)]
        ids, parts = [i for i, _ in kept], [p for _, p in kept]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        # Known pairs and the lengths of the items that have them; an item of one word counts as a pair.
        known = [pairs_of(p)[: max(1, len(p) - 1)] for p in parts]
        pairs = np.concatenate(known) if parts else words
        of = np.repeat(sizes, [len(k) for k in known])
        pairs, of = np.unique(np.stack([pairs, of.astype(np.uint64)]), axis=1) if parts else (pairs, of)
        keys = walk_keys(words, bounds[:-1], sizes, bounds[1:]) if parts else np.zeros((WALKS, 0), dtype=np.uint64)
        order = np.argsort(keys, axis=1, kind="stable")
        return Items(ids, words, bounds, pairs, of.astype(np.int64), np.take_along_axis(keys, order, 1), order)

    def windows(self, words: np.ndarray, first: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(starts, lengths)`` of the windows that hold enough known pairs; documents begin at ``first``.

        The known pairs of one length stand in a sorted list; ``need`` of them in a row that lie within one window
        give the range of its starts.  The work follows the known pairs, not the words.
        """
        pairs = pairs_of(words)
        alone = mix(words * U(3) + PAD)
        starts, lengths = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        table = np.zeros(1 << 20, dtype=bool)
        table[(self.pairs >> U(44)).astype(np.int64)] = True
        at, size = self._known(pairs, table)
        single, one = self._known(alone, table)
        single = single[one == 1]
        starts.append(single)
        lengths.append(np.ones(len(single), dtype=np.int64))
        order = np.lexsort((at, size))
        at, size = at[order], size[order]
        for n in np.unique(size[size > 1]).tolist():
            spots = at[np.searchsorted(size, n, "left") : np.searchsorted(size, n, "right")]
            need = n - 1 - 2 * edits_allowed(n)
            if len(spots) < need:
                continue
            low, high = spots[: len(spots) - need + 1], spots[need - 1 :]
            near = (high - low <= n - 2) & (document[low] == document[high])
            low, high = low[near], high[near]
            begin = np.maximum(high - (n - 2), first[document[low]])
            count = low - begin + 1
            spread = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            spread = np.unique(spread)
            starts.append(spread)
            lengths.append(np.full(len(spread), n, dtype=np.int64))
        return np.concatenate(starts), np.concatenate(lengths)

    def _known(self, pairs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(position, length)`` of every known pair and every length of its items."""
        maybe = np.flatnonzero(table[(pairs >> U(44)).astype(np.int64)])
        low = np.searchsorted(self.pairs, pairs[maybe], "left")
        count = np.searchsorted(self.pairs, pairs[maybe], "right") - low
        which = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(maybe, count), self.sizes[which]

    def meet(self, keys: np.ndarray, walks: slice) -> tuple[np.ndarray, np.ndarray]:
        """``(window, item)`` pairs that share a key."""
        windows, items = [], []
        for mine, theirs, owner in zip(keys, self.keys[walks], self.owners[walks], strict=True):
            low, high = np.searchsorted(theirs, mine, "left"), np.searchsorted(theirs, mine, "right")
            hit = np.flatnonzero(high > low)
            for w, a, b in zip(hit.tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                windows.extend([w] * (b - a))
                items.extend(owner[a:b].tolist())
        return np.array(windows, dtype=np.int64), np.array(items, dtype=np.int64)

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text, item, edits, first byte, last byte)`` of each item that a text holds."""
        separator = separators(keep_punctuation=False)
        for first, last, raw, offsets in blocks(texts):
            begin, end, words = word_hashes(raw, separator)
            if not len(words) or not self.ids:
                continue
            cuts = np.searchsorted(begin, offsets)
            document = np.repeat(np.arange(last - first), np.diff(cuts))
            document_end = cuts[1:][document]
            starts, lengths = self.windows(words, cuts[:-1], document)
            if not len(starts):
                continue
            # Every window takes every walk: what is found near it for one item says nothing of another item.
            window, item = self._meet(words, starts, lengths, document_end)
            for doc, one, low, high in stretches(document[starts[window]], item, starts[window], lengths[window]):
                target = self.words[self.bounds[one] : self.bounds[one + 1]]
                # A window that meets an item may start up to 2 k words from it, and the part is up to k words longer.
                slack = 3 * int(edits_allowed(len(target))) + 1
                low, high = max(int(cuts[doc]), low - slack), min(int(cuts[doc + 1]), high + slack)
                edits, stop = edit_distance_within(target, words[low:high])
                if edits <= edits_allowed(len(target)):
                    yield first + doc, one, edits, int(begin[max(low, low + stop - len(target))] - offsets[doc]), int(end[max(low, low + stop - 1)] - offsets[doc])

    def _meet(self, words, starts, lengths, document_end) -> tuple[np.ndarray, np.ndarray]:
        """``(window, item)`` pairs; windows of equal words, as runs of one word have, walk once."""
        ends = np.minimum(starts + lengths, document_end[starts])
        prefix = np.concatenate(([PAD], np.cumsum(words * powers(BASE, len(words)))))
        content = (prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, len(words) + 1)[starts]
        content = mix(content + lengths.astype(np.uint64) * U(3) + (ends - starts).astype(np.uint64) * U(7))
        _, chosen, back = np.unique(content, return_index=True, return_inverse=True)
        met = []
        for walks in (slice(a, a + WALKS_AT_ONCE) for a in range(0, WALKS, WALKS_AT_ONCE)):
            keys = [
                walk_keys(words, starts[some], lengths[some], ends[some], walks)
                for some in (chosen[a : a + AT_ONCE] for a in range(0, len(chosen), AT_ONCE))
            ]
            met.append(np.stack(self.meet(np.concatenate(keys, axis=1)[:, back], walks)))
        return tuple(np.unique(np.concatenate(met, axis=1), axis=1))


def stretches(doc: np.ndarray, item: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Windows of one document and item that overlap, as one stretch ``(doc, item, low, high)``."""
    order = np.lexsort((start, item, doc))
    held = None
    for d, i, s, n in zip(doc[order].tolist(), item[order].tolist(), start[order].tolist(), size[order].tolist(), strict=True):
        if held and held[0] == d and held[1] == i and s <= held[3]:
            held[3] = max(held[3], s + n)
            continue
        if held:
            yield tuple(held)
        held = [d, i, s, s + n]
    if held:
        yield tuple(held)


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, read one after the other."""
    ids, texts, held = [], [], 0
    for row in plain(benchmark, item_id="item_id", text="text").orderBy("item_id", "text").toLocalIterator():
        size = len(row.text or "") // 2 + 1
        if ids and held + size > block_words:
            yield Items.build(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        held += size
    yield Items.build(ids, texts)


LEAK = "doc_id long, item_id long, edits int, first_byte int, last_byte int"


def leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, edits, first_byte, last_byte)``: every item found, best stretch first, once a document."""
    spark = docs.sparkSession
    named = plain(docs, doc_id="doc_id", text="text")
    found = None
    for items in item_blocks(benchmark, block_words):
        held = spark.sparkContext.broadcast(items)

        def run(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for part in parts:
                for at in range(0, len(part), 1024):
                    few = part.iloc[at : at + 1024]
                    names, items = few["doc_id"].tolist(), held.value
                    rows = [(names[d], items.ids[i], *rest) for d, i, *rest in items.leaks(few["text"].tolist())]
                    frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "first_byte", "last_byte"])
                    yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

        here = named.mapInPandas(run, LEAK)
        found = here if found is None else found.unionByName(here)
    best = F.min_by(F.struct("edits", "first_byte", "last_byte"), F.struct("edits", "first_byte")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with."""
    name = free_name(docs.columns, "_leak")
    hit = leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def op3_decontaminate(spark, sf: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
