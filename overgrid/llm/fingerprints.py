"""Document fingerprints from prefix polynomial hashes.

A text of code points c has the prefix array H[i] = sum of c[k] B^k for k < i, modulo 2^31 - 1, for two bases.  Any
span's hash is (H[j] - H[i]) B^-i, so two spans are compared in constant time and the longest common extension of two
places is found by binary search.  The prefix array of a text with a replaced tail is made of the arrays of its parts.

A fingerprint is ``length:whole:sketch``: the hash of the whole text under both bases, and the 64 smallest distinct
hashes of its spans of 12 code points (for texts under 48 code points of 3 and of 1 as well).  The likeness of two
fingerprints is 1 if length and whole agree, else the share of common values among the smallest of both sketches.

Null texts are empty; empty texts are like each other and like nothing else.  Rows that repeat an id follow each
other by text.  A row with a null id has no place in the order and is its own next document; so is the only row of a
table.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overgrid.llm.common import partitions, plain, text_of

P = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_017)
SPAN, SHORT, SKETCH = 12, 48, 64
#: Ranges of the id order for each partition, so that hashing ranges to partitions stays even.
RANGES_PER_PARTITION = 8

_TABLES: dict[tuple[int, int], np.ndarray] = {}


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x under 2^62."""
    x = (x >> np.uint64(31)) + (x & np.uint64(P))
    x = (x >> np.uint64(31)) + (x & np.uint64(P))
    return np.where(x >= P, x - np.uint64(P), x)


def powers(base: int, n: int) -> np.ndarray:
    """``base^0 .. base^(n-1)`` modulo 2^31 - 1, by doubling; kept by the worker."""
    had = _TABLES.get((base, P))
    if had is None or len(had) < n:
        size, filled = 1 << max(10, int(n).bit_length()), 1
        had = np.ones(size, dtype=np.uint64)
        while filled < size:
            had[filled : 2 * filled] = fold(had[:filled] * np.uint64(pow(base, filled, P)))
            filled *= 2
        _TABLES[base, P] = had
    return had[:n]


INVERSES = tuple(pow(b, -1, P) for b in BASES)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


class Prefix:
    """The prefix arrays of one text."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays
        self.length = len(arrays[0]) - 1

    @staticmethod
    def of(text: str) -> Prefix:
        points = code_points(text) + np.uint64(1)
        arrays = []
        for base in BASES:
            table = np.zeros(len(points) + 1, dtype=np.uint64)
            np.cumsum(fold(points * powers(base, len(points))), out=table[1:])
            arrays.append(fold(table))
        return Prefix(arrays)

    def spliced(self, keep: int, other: Prefix, take: int) -> Prefix:
        """The first ``keep`` code points of this text and the first ``take`` of the other."""
        arrays = []
        for base, mine, theirs in zip(BASES, self.arrays, other.arrays, strict=True):
            tail = fold(theirs[1 : take + 1] * powers(base, keep + 1)[keep])
            arrays.append(np.concatenate((mine[: keep + 1], fold(tail + mine[keep]))))
        return Prefix(arrays)

    def span(self, start: int, length: int) -> tuple[int, ...]:
        """One span's hash under all bases."""
        return tuple(
            (int(table[start + length]) - int(table[start])) * int(powers(inverse, self.length + 1)[start]) % P
            for table, inverse in zip(self.arrays, INVERSES, strict=True)
        )

    def whole(self) -> int:
        return int(self.arrays[0][-1]) << 31 | int(self.arrays[1][-1])

    def sketch(self) -> np.ndarray:
        widths = [SPAN] if self.length >= SHORT else [w for w in (SPAN, 3, 1) if w <= self.length]
        values = [self._slid(w) for w in widths]
        return smallest(np.concatenate(values)) if values else np.zeros(0, dtype=np.uint64)

    def _slid(self, width: int) -> np.ndarray:
        table = self.arrays[0]
        difference = fold(table[width:] + np.uint64(P) - table[:-width])
        hashes = fold(difference * powers(INVERSES[0], self.length + 1)[: self.length - width + 1])
        return (hashes * np.uint64(0x9E3779B1) + np.uint64(width)) & np.uint64(0xFFFFFFFF)


def smallest(values: np.ndarray, count: int = SKETCH) -> np.ndarray:
    """The ``count`` smallest distinct values, in order."""
    few = np.partition(values, 4 * count)[: 4 * count] if len(values) > 8 * count else values
    found = np.unique(few)
    if len(found) < count and len(few) < len(values):
        found = np.unique(values)
    return found[:count]


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """The number of code points from ``i`` in one text that go on like those from ``j`` in the other."""
    low, high = 0, min(a.length - i, b.length - j)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a.span(i, middle) == b.span(j, middle) else (low, middle - 1)
    return low


class Print:
    """A fingerprint with the arrays that it was read from."""

    def __init__(self, prefix: Prefix):
        self.prefix, self.sketch = prefix, prefix.sketch()
        self.text = f"{prefix.length:x}:{prefix.whole():016x}:{self.sketch.astype('>u4').tobytes().hex()}"

    def like(self, other: Print) -> float:
        return likeness(self, other)


def likeness(a: Print, b: Print) -> float:
    if a.prefix.length == b.prefix.length and a.prefix.whole() == b.prefix.whole():
        return 1.0
    if not len(a.sketch) or not len(b.sketch):
        return 0.0
    # Below the end of a full sketch both are known completely.
    union = np.union1d(a.sketch, b.sketch)[: SKETCH if max(len(a.sketch), len(b.sketch)) == SKETCH else None]
    both = np.isin(union, a.sketch) & np.isin(union, b.sketch)
    return min(float(both.mean()), 1 - 1e-6)


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, common_prefix long"
)


def compared(doc_id, text: str, mine: Print, next_text: str, theirs: Print) -> tuple:
    """One result row: a text, its edited text and the next document's text."""
    n = mine.prefix.length
    take = n // 3
    edited = text[: n - take] + next_text[:take]
    other = Print(mine.prefix.spliced(n - take, theirs.prefix, min(take, theirs.prefix.length)))
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    shared = common_extension(mine.prefix, 0, other.prefix, 0)
    return doc_id, n, sha, mine.text, other.text, mine.like(other), mine.like(theirs), shared


def _pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by range, own rows first, then by falling id: each row's next is the row after it."""
    before, rows, alone = None, [], False
    for part in parts:
        for where, foreign, doc_id, text in part[["range", "foreign", "doc_id", "text"]].itertuples(index=False):
            if before and before[0] != where:
                before = None
            if before or not foreign:
                made = Print(Prefix.of(text))
            if before:
                rows.append(compared(*before[1:], text, made))
            alone = where < 0
            if alone:  # a null id: its own next
                rows.append(compared(None, text, made, text, made))
            before = None if foreign or alone else (where, doc_id, text, made)
            if len(rows) >= 512:
                yield _framed(rows)
                rows = []
    if rows:
        yield _framed(rows)


def _framed(rows: list[tuple]) -> pd.DataFrame:
    names = [column.split()[0] for column in RESULT.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see the contract in ``RESULT``.

    The id order is cut in ranges by approximate quantiles.  A range's first row also goes to the range before, as
    the next document of that range's last row.  So one shuffle by range pairs all neighbours; only the bounds of the
    ranges and their first ids, a few numbers for each partition, pass through the driver.
    """
    spark = docs.sparkSession
    named = plain(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    count = RANGES_PER_PARTITION * partitions(spark)
    ids = named.select("doc_id").filter("doc_id IS NOT NULL")
    bounds = np.unique(ids.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.2 / count)).astype(np.int64)

    @F.pandas_udf(T.LongType())
    def range_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, values.to_numpy(dtype=np.int64), side="right"))

    heads = {r["range"]: r["head"] for r in ids.groupBy(range_of("doc_id").alias("range")).agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    target = {low: high for low, high in zip(order, order[1:] + order[:1], strict=True)}

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            known = part["doc_id"].notna().to_numpy()
            values = part["doc_id"].fillna(0).to_numpy(dtype=np.int64)
            where = np.searchsorted(bounds, values, side="right").astype(np.int64)
            spread = pd.util.hash_array(part["text"].to_numpy(dtype=object)).astype(np.int64) % count
            own = part.assign(range=np.where(known, where, -1 - np.abs(spread)), foreign=False)
            is_head = known & np.array([heads[r] == v if k else False for r, v, k in zip(where.tolist(), values.tolist(), known.tolist(), strict=True)], dtype=bool)
            copies = own[is_head].assign(foreign=True)
            copies["range"] = [target[r] for r in copies["range"].tolist()]
            for frame in (own, copies):
                yield frame.astype({"doc_id": "Int64"})[["range", "foreign", "doc_id", "text"]]

    placed = named.withColumn("text", text_of("text")).mapInPandas(place, "range long, foreign boolean, doc_id long, text string")
    spread = placed.repartition(partitions(spark), "range").sortWithinPartitions("range", "foreign", F.desc("doc_id"), "text")
    return spread.mapInPandas(_pairs, RESULT)


def op1_fingerprints(spark, sf: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf}/documents.parquet"))
