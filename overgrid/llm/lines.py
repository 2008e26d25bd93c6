"""Line dedup: two Bloom filters, and exact confirmation of what they suspect.

A line's key is the line stripped of ASCII white space at both ends, ``A-Z`` lower-cased.  A key of at least
``min_chars`` code points that at least two documents hold loses its lines in all of them but the one with the
smallest id.

Pass 1 puts the hash of every key into two filters: *once* holds all keys, *twice* those that a second document
brought.  Parts of the table are merged by ``once = A | B`` and ``twice = A2 | B2 | (A & B)``, slice by slice of
the bit array, as a stream.  Pass 2 sends only keys that *twice* knows to a shuffle, where an aggregate of the keys
themselves decides.  A filter only errs by suspecting too much, so the result is exact whatever the filter's size.

Null and empty texts are one empty line.  Rows with a null id count as one document after all others.  Rows that
repeat an id are the same document.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overgrid.llm.common import free_name, partitions, shared_folder, stored, text_of
from overgrid.llm.words import SPACE

MIN_CHARS = 10
#: Bits of a slice of the filters, and the largest filter (its size on each worker is 1/8 byte a bit).
SLICE = 1 << 18
MAX_BITS = 1 << 30
LAST_ID = (1 << 63) - 1


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None if it is too short to be dropped."""
    key = line.strip(SPACE).lower()
    if len(key) >= 4 * min_chars:
        return key
    return key if len(key) >= min_chars and len(key.decode("utf-8", "surrogatepass")) >= min_chars else None


def keyed_lines(text: str | None, min_chars: int) -> list[tuple[int, bytes]]:
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return [(i, key) for i, line in enumerate(lines) if (key := key_of(line, min_chars)) is not None]


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


class Filters:
    """The pair of filters over one part of the table; bits are bytes until the part is done."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, dtype=np.uint8)
        self.twice = np.zeros(bits // 8, dtype=np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Add the keys of several documents, each key once for each document."""
        distinct, count = np.unique(hashes, return_counts=True)
        seen = self._has(self.once, distinct) | (count > 1)
        self._set(self.twice, distinct[seen])
        self._set(self.once, distinct)

    def _has(self, table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return probe(table, hashes)

    def _set(self, table: np.ndarray, hashes: np.ndarray) -> None:
        for place in places(hashes, self.bits):
            np.bitwise_or.at(table, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def slices(self) -> Iterator[tuple[int, bytes, bytes]]:
        for k, at in enumerate(range(0, self.bits // 8, SLICE // 8)):
            once = self.once[at : at + SLICE // 8]
            if once.any():
                yield k, zlib.compress(once.tobytes(), 1), zlib.compress(self.twice[at : at + SLICE // 8].tobytes(), 1)


def probe(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    found = np.ones(len(hashes), dtype=bool)
    for place in places(hashes, len(table) * 8):
        found &= (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def build_filters(docs: DataFrame, text: str, bits: int, min_chars: int) -> DataFrame:
    """``(slice, twice)`` of the whole table.  Each part of the table sends its filters, compressed, by slice."""

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = Filters(bits)
        for part in parts:
            held: list[int] = []
            for value in part["text"]:
                held.extend({xxhash.xxh3_64_intdigest(key) for _, key in keyed_lines(value, min_chars)})
            filters.add(np.array(held, dtype=np.uint64))
        found = list(filters.slices())
        for at in range(0, len(found), 64):
            yield pd.DataFrame(found[at : at + 64], columns=["slice", "once", "twice"])

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by slice; only one slice is held at a time."""
        at, once, twice = None, None, None
        for part in parts:
            for k, a, b in part.itertuples(index=False):
                other, more = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (a, b))
                if k == at:
                    twice |= more | (once & other)
                    once |= other
                    continue
                if at is not None and twice.any():
                    yield pd.DataFrame({"slice": [at], "twice": [zlib.compress(twice.tobytes(), 1)]})
                at, once, twice = k, other.copy(), more.copy()
        if at is not None and twice.any():
            yield pd.DataFrame({"slice": [at], "twice": [zlib.compress(twice.tobytes(), 1)]})

    filled = docs.select(F.col(f"`{text}`").alias("text")).mapInPandas(fill, "slice int, once binary, twice binary")
    sorted_parts = filled.repartition(partitions(docs.sparkSession), "slice").sortWithinPartitions("slice")
    return sorted_parts.mapInPandas(merge, "slice int, twice binary")


def filter_bits(lines: int) -> int:
    """A power of two of about 16 bits a line, up to ``MAX_BITS``."""
    return min(MAX_BITS, max(SLICE, 1 << int(16 * max(1, lines) - 1).bit_length()))


def suspects(docs: DataFrame, twice: np.ndarray, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``(id, sig, key, lines)``: the keys of each document that the filter knows, and where they stand."""
    held = docs.sparkSession.sparkContext.broadcast(twice)  # MAX_BITS / 8 bytes at most

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, sig, value in part[["id", "sig", "text"]].itertuples(index=False):
                by_key: dict[bytes, list[int]] = {}
                for i, key in keyed_lines(value, min_chars):
                    by_key.setdefault(key, []).append(i)
                if not by_key:
                    continue
                hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in by_key], dtype=np.uint64)
                hit = probe(held.value, hashes)
                rows.extend((name, sig, k, by_key[k]) for k, known in zip(by_key, hit, strict=True) if known)
            yield pd.DataFrame(rows, columns=["id", "sig", "key", "lines"])

    named = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(text_of(F.col(f"`{text}`"))).alias("sig"),
        F.col(f"`{text}`").alias("text"),
    )
    return named.mapInPandas(find, "id long, sig long, key binary, lines array<int>")


def drop_lists(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(id, sig, lines)``: per document with lines to drop, their numbers.  ``sig`` tells rows of one id apart."""
    spark = docs.sparkSession
    value = text_of(F.col(f"`{text}`"))
    counted = docs.agg(F.sum(F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit(""))) + 1).alias("n"))
    bits = filter_bits(int(counted.first()["n"] or 0))
    twice = np.zeros(bits // 8, dtype=np.uint8)
    for k, raw in build_filters(docs, text, bits, min_chars).toLocalIterator():
        twice[k * SLICE // 8 : (k + 1) * SLICE // 8] = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    found = stored(suspects(docs, twice, doc_id, text, min_chars), "suspects", shared_folder(spark))
    repeated = found.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    confirmed = stored(repeated.select("key", "first"), "confirmed", shared_folder(spark))
    lost = found.join(confirmed, "key").filter("id > first")
    return lost.groupBy("id", "sig").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


@F.pandas_udf(KEPT)
def without_lines(text: pd.Series, lines: pd.Series) -> pd.DataFrame:
    rows = []
    for value, drop in zip(text, lines, strict=True):
        all_lines = (value or "").split("\n")
        gone = () if drop is None else set(drop)
        kept = [line for i, line in enumerate(all_lines) if i not in gone] if gone else all_lines
        rows.append(("\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, column: str = "kept") -> DataFrame:
    """``docs`` with a struct ``column (text, n_lines, n_dropped)``."""
    drops = drop_lists(docs, doc_id, text, min_chars)
    a, b, c = (free_name(docs.columns, x) for x in ("_id", "_sig", "_lines"))
    keyed = docs.withColumns(
        {a: F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID)), b: F.xxhash64(text_of(F.col(f"`{text}`")))}
    )
    joined = keyed.join(drops.toDF(a, b, c), [a, b], "left")
    return joined.withColumn(column, without_lines(F.col(f"`{text}`"), F.col(c))).drop(a, b, c)


def line_dedup_stage(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the texts that are left and their lengths."""
    name = free_name(docs.columns, "_kept")
    done = line_dedup(docs, column=name)
    changed = {"text": F.col(f"{name}.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(F.col(f"{name}.text")).cast(docs.schema["n_chars"].dataType)
    return done.withColumns(changed).select(*docs.columns)


ORACLE = r"""with lines as (
  select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents) s),
firsts as (select key, min(doc_id) as first from lines where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
marked as (select l.*, f.first is not null and l.doc_id > f.first as gone from lines l left join firsts f using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id"""


def op6_line_dedup(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", F.col("kept.n_lines").alias("n_lines"), F.col("kept.n_dropped").alias("n_dropped"),
        F.sha2(F.col("kept.text"), 256).alias("kept_sha256"),
    )
