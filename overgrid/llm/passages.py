"""Substring dedup: verbatim passages that repeat across documents, wherever their lines break.

A passage is a run of ``PASSAGE`` words or more (runs of other than ASCII white space, ``A-Z`` lower-cased) that also
stands in an earlier document, one of smaller id.  Lines play no part: a passage may lie inside a line, straddle
lines or be wrapped in short ones.  Every run of ``PASSAGE`` words counts that an earlier document holds; runs that
go on side by side in both documents are one passage, and its source is the earliest document that holds it.

Texts are winnowed first: of every ``WINDOW`` neighbouring grams of ``GRAM`` words the least is picked, so two texts
that share ``PASSAGE`` words share a pick, for certain.  Only around picks that two documents have are all runs of
``PASSAGE`` words compared, by 64 bits of hash.  A copy of a whole text is one passage and isn't compared.

Null and empty texts hold nothing.  Rows with a null id are passed over.  Rows that repeat an id are one document,
and repeats inside one document are left alone.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overgrid.llm.common import partitions, plain, shared_folder, stored, text_of
from overgrid.llm.words import blocks, runs, separators, word_hashes

PASSAGE, GRAM = 50, 25
WINDOW = PASSAGE - GRAM + 1


def least(grams: np.ndarray) -> np.ndarray:
    """The places of the least gram (the first of equals) of every window, by windows that double in size."""
    return np.unique(least_of_windows(grams))


def least_of_windows(grams: np.ndarray) -> np.ndarray:
    """The place of the least gram (the first of equals) of the window that begins at each place."""
    held, at, size = grams, np.arange(len(grams), dtype=np.int32), 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        first = held[:-step] <= held[step:]
        held, at, size = np.where(first, held[:-step], held[step:]), np.where(first, at[:-step], at[step:]), size + step
    return at


def beginnings(bounds: np.ndarray) -> np.ndarray:
    """Whether ``PASSAGE`` words of one text begin at each place of a run of texts whose words begin at ``bounds``."""
    edge = np.zeros(int(bounds[-1]) + 1, dtype=np.int64)
    long = np.diff(bounds) >= PASSAGE
    edge[bounds[:-1][long]] += 1
    edge[bounds[1:][long] - PASSAGE + 1] -= 1
    return np.cumsum(edge)[:-1] > 0


def picks(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(grams, places)`` picked from a run of texts: the least gram (the first of equals) of every window of a text."""
    if len(words) < PASSAGE:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    grams, picked = runs(words, GRAM), np.zeros(len(words), dtype=bool)
    picked[least_of_windows(grams)[beginnings(bounds)[: len(words) - PASSAGE + 1]]] = True
    places = np.flatnonzero(picked)
    return grams[places], places


def runs_around(words: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(runs, starts)``: all runs of ``PASSAGE`` words inside a text that hold the gram at one of the places."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.maximum(0, places - WINDOW + 1), 1)
    np.add.at(edge, places + 1, -1)
    starts = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & beginnings(bounds))
    return runs(words, PASSAGE)[starts], starts


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, words, bounds)``: hashes of the words of runs of texts, and where each text's words begin."""
    separator = separators()
    for first, last, raw, offsets in blocks(texts):
        starts, _, hashes = word_hashes(raw, separator)
        yield first, last, hashes, np.searchsorted(starts, offsets)


def _rows(some: pd.DataFrame, bounds: np.ndarray, places: np.ndarray, hashes: np.ndarray, **names: str) -> tuple[pd.DataFrame, np.ndarray]:
    """A row for each place, and the number of its text."""
    owner = np.searchsorted(bounds, places, side="right") - 1
    rows = {names["hash"]: hashes.view(np.int64), "doc_id": some["doc_id"].to_numpy()[owner], "text_id": some["text_id"].to_numpy()[owner]}
    return pd.DataFrame(rows | {names["place"]: (places - bounds[owner]).astype(np.int32)}), owner


def _picked(texts: DataFrame) -> DataFrame:
    """``(gram, doc_id, text_id, place, words)`` of every pick; the first of a text tells its number of words, the others 0."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                few = part.iloc[at : at + 256]
                for first, last, words, bounds in _blocks(few["text"].tolist()):
                    grams, places = picks(words, bounds)
                    rows, owner = _rows(few.iloc[first:last], bounds, places, grams, hash="gram", place="place")
                    yield rows.assign(words=np.where(np.diff(owner, prepend=-1) > 0, np.diff(bounds)[owner], 0).astype(np.int32))

    return texts.mapInPandas(run, "gram long, doc_id long, text_id binary, place int, words int")


def _runs(texts: DataFrame) -> DataFrame:
    """``(run, doc_id, text_id, start)`` around the ``places`` of each text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 64):
                few = part.iloc[at : at + 64]
                for first, last, words, bounds in _blocks(few["text"].tolist()):
                    some = few.iloc[first:last]
                    places = np.concatenate([np.asarray(p, dtype=np.int64) + b for p, b in zip(some["places"], bounds.tolist())])
                    found, starts = runs_around(words, bounds, places)
                    yield _rows(some, bounds, starts, found, hash="run", place="start")[0]

    return texts.mapInPandas(run, "run long, doc_id long, text_id binary, start int")


SPAN = "doc_id long, text_id binary, first_word int, words int, first_doc_id long, first_doc_word int"


def _joined(held: DataFrame) -> DataFrame:
    """``SPAN``: runs ``(doc_id, text_id, start, first_doc_id, first_start)`` that go on side by side, as one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by text and start; only the span that a batch ends in is held."""
        held = None
        for part in parts:
            if not len(part):
                continue
            names = part["text_id"].to_numpy()
            doc, start = part["doc_id"].to_numpy(), part["start"].to_numpy().astype(np.int64)
            first, there = part["first_doc_id"].to_numpy(), part["first_start"].to_numpy().astype(np.int64)
            goes_on = (doc[1:] == doc[:-1]) & (names[1:] == names[:-1]) & (first[1:] == first[:-1]) & (np.diff(start) == 1) & (np.diff(there) == 1)
            heads = np.flatnonzero(np.concatenate(([True], ~goes_on)))
            tails = np.append(heads[1:], len(part)) - 1
            rows = [[int(doc[a]), bytes(names[a]), int(start[a]), int(start[b] - start[a]) + PASSAGE, int(first[a]), int(there[a])] for a, b in zip(heads, tails, strict=True)]
            if held:
                size = held[3] - PASSAGE + 1
                if rows[0] == [held[0], held[1], held[2] + size, rows[0][3], held[4], held[5] + size]:
                    rows[0] = [*held[:3], held[3] + rows[0][3] - PASSAGE + 1, *held[4:]]
                else:
                    rows.insert(0, held)
            held = rows.pop()
            yield pd.DataFrame(rows, columns=["doc_id", "text_id", "first_word", "words", "first_doc_id", "first_doc_word"])
        if held:
            yield pd.DataFrame([held], columns=["doc_id", "text_id", "first_word", "words", "first_doc_id", "first_doc_word"])

    n = partitions(held.sparkSession)
    return held.repartition(n, "doc_id").sortWithinPartitions("doc_id", "text_id", "start").mapInPandas(run, SPAN)


def text_name(text: str | Column) -> Column:
    return F.unhex(F.md5(text_of(text)))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``SPAN``: every passage of each text that an earlier document holds; ``text_id`` is the text's MD5."""
    folder = shared_folder(docs.sparkSession)
    named = plain(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    named = named.withColumn("text_id", text_name("text"))
    # Rows that repeat an id and text give equal rows, which count once.
    picked = stored(_picked(named), "passage-picks", folder)
    # Every text of PASSAGE words has a first pick, which tells its words: no text is moved to know copies.
    counted = picked.filter("words > 0").select("doc_id", "text_id", "words")
    owners = stored(counted.groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")), "passage-texts", folder)
    again = counted.join(owners.filter("doc_id < last").select("text_id", F.col("doc_id").alias("first_doc_id")), "text_id").filter("doc_id > first_doc_id")
    copies = again.select("doc_id", "text_id", F.lit(0).alias("first_word"), "words", "first_doc_id", F.lit(0).alias("first_doc_word")).distinct()

    # Copies have each other's grams, so a gram is shared if two texts have it; only a text's first document goes on.
    named_grams = picked.select("gram", "doc_id", "text_id", "place", F.xxhash64("text_id").alias("t"))
    shared = named_grams.groupBy("gram").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a < b").select("gram")
    places = named_grams.join(shared, "gram").groupBy("doc_id", "text_id").agg(F.collect_set("place").alias("places"))
    places = stored(places.join(owners.select("text_id", "doc_id"), ["text_id", "doc_id"], "left_semi"), "passage-places", folder)
    texts = named.join(places, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "places")
    around = stored(_runs(texts), "passage-runs", folder)
    first = around.groupBy("run").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"))
    first = stored(first.filter("first.doc_id < last").select("run", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")), "passage-first", folder)
    held = around.join(first, "run").filter("doc_id > first_doc_id").select("doc_id", "text_id", "start", "first_doc_id", "first_start").distinct()
    return stored(_joined(held).unionByName(copies), "passage-spans", folder)


def passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, first_word, words, first_doc_id, first_doc_word, kept)``: passages, and the places where they stay."""
    found = spans(docs).drop("text_id")
    stay = found.select(F.col("first_doc_id").alias("doc_id"), F.col("first_doc_word").alias("first_word"), "words", "first_doc_id", "first_doc_word")
    return found.withColumn("kept", F.lit(False)).unionByName(stay.withColumn("kept", F.lit(True))).distinct()


def cut(text: str | None, lines, words) -> str | None:
    """The text without these lines and these ``(first word, words)``; words and lines are those of the whole text."""
    if lines is None and words is None:
        return text
    raw = (text or "").encode("utf-8", "surrogatepass")
    begin, end, _ = word_hashes(raw + b"\n", separators())
    stays = np.ones(len(raw) + 1, dtype=bool)
    for at, count in words if words is not None else ():
        stays[begin[at] : end[at + count - 1]] = False
    held = set(lines) if lines is not None else set()
    out, at = [], 0
    for i, line in enumerate(raw.split(b"\n")):
        if i not in held:
            out.append(np.frombuffer(line, dtype=np.uint8)[stays[at : at + len(line)]].tobytes())
        at += len(line) + 1
    return b"\n".join(out).decode("utf-8", "surrogatepass")
