"""Phrase collocation mining with broadcast double-array tries.

Texts are lower-cased (``A-Z``), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words.
Everything is per language; a null language is ``und``.

1. Texts become arrays once: each run of texts has its distinct words, and its words in order as numbers of those, 0
   between pieces.  The vocabulary is counted on the way.
2. Candidates grow level by level, Apriori-safe: a run of m words is looked at only where both of its runs of m - 1
   words are frequent.  What is frequent goes out as a Bloom filter of bounded size, which may let more pass, never less.
   Keys travel sorted and packed, with the part of the arrays that has them; one part tells what a frequent key is made of.
3. The candidates of all lengths are dealt over tries of at most ``TRIE_PHRASES`` phrases.  Trie by trie, every task
   advances all text positions' states together, counts accepting states, and the counts of all parts are summed.
   These sums are the frequencies; the candidates' own counts only propose.

So a worker holds one trie and the filters, whatever the corpus' size; a corpus with more frequent phrases takes more
passes over the arrays.  Two words of one hash would be taken for each other: the vocabulary shows that, and the
arrays are then made anew with another salt.

Null and empty texts have no words.  Ids play no part: each row of a repeated document counts.  An empty table, or one
without frequent phrases, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overgrid.llm import trie
from overgrid.llm.common import partitions, plain, shared_folder, stored, text_of
from overgrid.llm.words import U, mix, word_hashes

LEAST, LONGEST, TOP = 100, 5, 2000
#: Phrases of one trie, bits of the largest Bloom filter, bits of a slice of it, pairs that a task holds before it sends them.
TRIE_PHRASES = 250_000
FILTER_BITS = 1 << 28
SLICE = 1 << 18
PAIRS_HELD = 500_000
#: Blocks that keys are dealt by, at least, and the keys of a block for which there are more.
LEAST_BLOCKS, BLOCK_KEYS = 1024, 2_000_000
#: Bytes of text that make one row of the arrays, and rows of a table that are read at once.
CHUNK = 1 << 18
ROWS = 1024
#: Counts of one row that a task sends.
COUNTS = 512
NO_LANG = "und"

BREAKS = b".,;:!?\n\x0b\x0c\r"
IS_BREAK = np.isin(np.arange(256), list(BREAKS))
SEPARATES = IS_BREAK | np.isin(np.arange(256), list(b" \t"))


def chunks(texts: list[str | None]) -> Iterator[bytes]:
    """The texts' bytes in runs of about ``CHUNK``, cut only between pieces."""
    raw = b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts) + b"\n"
    at = 0
    while at < len(raw):
        upto = at + CHUNK
        while upto < len(raw) and not len(ends := np.flatnonzero(IS_BREAK[np.frombuffer(raw, dtype=np.uint8, count=upto - at, offset=at)])):
            upto += CHUNK
        upto = len(raw) if upto >= len(raw) else at + int(ends[-1]) + 1
        yield raw[at:upto]
        at = upto


def salted(hashes: np.ndarray, lang: str, salt: int) -> np.ndarray:
    """Word hashes of a language; never 0."""
    name = word_hashes(lang.encode("utf-8", "surrogatepass") + b"\n", np.zeros(256, dtype=bool))[2][0]
    return np.maximum(mix(hashes + mix(np.array([name + U(salt)]))[0]), U(1))


def codes_type(distinct: int) -> str:
    """Two bytes a word where a run has few enough distinct words."""
    return "<u2" if distinct < 1 << 16 else "<u4"


def coded(raw: bytes, lang: str, salt: int = 0) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """``(codes, hashes, words, counts)``: the distinct words, and each word's number among them from 1, 0 between pieces."""
    starts, ends, hashes = word_hashes(raw, SEPARATES)
    piece = np.cumsum(IS_BREAK[np.frombuffer(raw, dtype=np.uint8)])[starts]
    shift = np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    distinct, index, inverse, counts = np.unique(salted(hashes, lang, salt), return_index=True, return_inverse=True, return_counts=True)
    codes = np.zeros(len(hashes) + (int(shift[-1]) if len(shift) else 0), dtype=codes_type(len(distinct)))
    codes[np.arange(len(hashes)) + shift] = inverse + 1
    low = raw.lower()
    words = [low[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
    return codes, distinct, words, counts


def read_back(codes: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, hashes)``, the hashes with a 0 in front, for code 0."""
    distinct = np.concatenate((np.zeros(1, dtype=np.uint64), np.frombuffer(hashes, dtype=np.uint64)))
    return np.frombuffer(codes, dtype=codes_type(len(distinct) - 1)), distinct


def encoded(docs: DataFrame, salt: int) -> DataFrame:
    """``(lang, codes, hashes, words, counts)`` from ``(lang, text)``, one row for each run of texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), ROWS):
                for lang, rows in part.iloc[at : at + ROWS].groupby("lang"):
                    for raw in chunks(rows["text"].tolist()):
                        codes, hashes, words, counts = coded(raw, lang, salt)
                        if len(words):
                            yield pd.DataFrame({"lang": [lang], "codes": [codes.tobytes()], "hashes": [hashes.tobytes()], "words": [words], "counts": [counts]})

    return docs.mapInPandas(run, "lang string, codes binary, hashes binary, words array<string>, counts array<long>")


def with_keys(vocabulary: DataFrame, salt: int) -> DataFrame:
    """``(lang, word, n, key)`` from ``(lang, word, n)``: the key is the word's hash in the arrays."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            raw = "\n".join(part["word"]).encode("utf-8", "surrogatepass") + b"\n"
            hashes = word_hashes(raw, SEPARATES)[2]
            keys = np.zeros(len(part), dtype=np.uint64)
            for lang in set(part["lang"]):
                own = (part["lang"] == lang).to_numpy()
                keys[own] = salted(hashes[own], lang, salt)
            yield part.assign(key=keys.view(np.int64))

    return vocabulary.select("lang", "word", "n").mapInPandas(run, "lang string, word string, n long, key long")


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a run of words from those of its first and last words but one."""
    return mix(a * U(0x9E3779B97F4A7C15) + mix(b))


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = U(bits - 1)
    return [(keys & mask).astype(np.int64), ((keys >> U(32)) & mask).astype(np.int64)]


def known(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key."""
    found = np.ones(len(keys), dtype=bool)
    for first in range(0, len(keys), 1 << 17):
        some = slice(first, first + (1 << 17))
        for at in places(keys[some], len(table) * 8):
            found[some] &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def bloom(keys: DataFrame, count: int, most: int = FILTER_BITS, each: int = 16) -> np.ndarray:
    """The Bloom filter of a table ``(key)``: ``each`` bits a key, ``most`` bits at most.  Slices are filled in tasks."""
    bits = min(most, max(SLICE, 1 << int(each * max(1, count) - 1).bit_length()))

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = np.concatenate(places(part["key"].to_numpy().view(np.uint64), bits))
            yield pd.DataFrame({"slice": (at // SLICE).astype(np.int32), "bit": (at % SLICE).astype(np.int32)})

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by slice; one slice is held at a time."""
        held, table = None, np.zeros(SLICE, dtype=bool)
        for part in parts:
            for number, rows in part.groupby("slice"):
                if held is not None and number != held:
                    yield pd.DataFrame({"slice": [held], "bits": [np.packbits(table, bitorder="little").tobytes()]})
                    table[:] = False
                held = number
                table[rows["bit"].to_numpy()] = True
        if held is not None:
            yield pd.DataFrame({"slice": [held], "bits": [np.packbits(table, bitorder="little").tobytes()]})

    rows = keys.select("key").mapInPandas(spread, "slice int, bit int").repartition(partitions(keys.sparkSession), "slice")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for number, raw in rows.sortWithinPartitions("slice").mapInPandas(fill, "slice int, bits binary").collect():
        out[number * (SLICE // 8) : (number + 1) * (SLICE // 8)] = np.frombuffer(raw, dtype=np.uint8)
    return out


def safe_pairs(codes: np.ndarray, hashes: np.ndarray, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(a, b)``: keys of the first and the last words but one of each run all of whose shorter runs may be frequent."""
    frequent = known(filters[0], hashes)
    frequent[0] = False
    key, alive = hashes[codes], frequent[codes]
    for table in filters[1:]:
        key, alive = combine(key[:-1], key[1:]), alive[:-1] & alive[1:]
        at = np.flatnonzero(alive)
        alive[at] = known(table, key[at])
    at = np.flatnonzero(alive[:-1] & alive[1:])
    return key[at], key[at + 1]


def _summed(key: np.ndarray, *columns: tuple[np.ndarray, np.ufunc]) -> list[np.ndarray]:
    """The distinct keys, sorted, and each column's values of a key as one."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else order
    return [key[first], *[f.reduceat(x[order], first) if len(first) else x for x, f in columns]]


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each stands here."""
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.diff(first, append=len(key))


def packed(keys: np.ndarray, start: int) -> bytes:
    """Sorted keys from ``start`` on as differences, the lowest bytes of all first, without the bytes that are 0 in all."""
    steps = np.diff(keys, prepend=U(start))
    wide = (int(steps.max()).bit_length() + 7) // 8 or 1
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def unpacked(raw: bytes, count: int, start: int) -> np.ndarray:
    """The ``count`` keys that ``packed`` made."""
    steps = np.zeros((count, 8), dtype=np.uint8)
    steps[:, : len(raw) // count] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, count).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + U(start)


def marks(keys: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """Names of keys in a part of the arrays."""
    return combine(keys, np.atleast_1d(np.asarray(part, dtype=np.int64)).astype(np.uint64))


def blocks_of(words: int) -> int:
    """Into how many blocks, by their first bits, the keys of so many words are cut."""
    return max(LEAST_BLOCKS, 1 << max(0, -(-words // BLOCK_KEYS) - 1).bit_length())


def pair_counts(arrays: DataFrame, filters: list, least: int, blocks: int) -> DataFrame:
    """``(block, part, keys, counts)``: how often Apriori-safe runs of ``len(filters) + 1`` words stand in each part.

    A block's keys are sorted and packed; counts end at ``least``, which is all that is asked of them.
    """
    kind, shift = "u1" if least < 1 << 8 else "<u4", 65 - blocks.bit_length()

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, held, size, at = [f.value for f in filters], [], 0, None
        for batch in rows:
            for codes, hashes, part in zip(batch["codes"], batch["hashes"], batch["part"], strict=True):
                if part != at and held:
                    yield told(at, *merged(held))
                    held, size = [], 0
                at = part
                held.append(_counted(combine(*safe_pairs(*read_back(codes, hashes), tables))))
                size += len(held[-1][0])
                if size > PAIRS_HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > PAIRS_HELD // 2:
                        yield told(at, *held[0])
                        held, size = [], 0
        if held:
            yield told(at, *merged(held))

    def merged(held: list) -> list[np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        return _summed(key, (n, np.add))

    def told(part: int, key: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        block, n = (key >> U(shift)).astype(np.int64), np.minimum(n, least).astype(kind)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(key)])).tolist() if len(key) else [0]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        numbers = [int(block[a]) for a, _ in spans]
        keys = [packed(key[a:b], number << shift) for (a, b), number in zip(spans, numbers, strict=True)]
        return pd.DataFrame({"block": np.array(numbers, dtype=np.int32), "part": np.full(len(spans), part, dtype=np.int32), "keys": pd.Series(keys, dtype=object), "counts": pd.Series([n[a:b].tobytes() for a, b in spans], dtype=object)})

    return arrays.select("codes", "hashes", "part").mapInPandas(run, "block int, part int, keys binary, counts binary")


def frequent_keys(told: DataFrame, least: int, blocks: int) -> DataFrame:
    """``(key, mark)`` of the keys that the parts of ``pair_counts`` have ``least`` times; the mark names the first part."""
    kind, shift = "u1" if least < 1 << 8 else "<u4", 65 - blocks.bit_length()

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block; one block is held at a time, its keys once."""
        at, held, size = None, [], 0
        for batch in rows:
            for block, part, keys, counts in zip(batch["block"], batch["part"], batch["keys"], batch["counts"], strict=True):
                if block != at and held:
                    yield often(*merged(held))
                    held, size = [], 0
                at, n = block, np.frombuffer(counts, dtype=kind).astype(np.int64)
                held.append((unpacked(keys, len(n), int(block) << shift), n, np.full(len(n), part, dtype=np.int32)))
                size += len(n)
                if size > 2 * BLOCK_KEYS:
                    held = [merged(held)]
                    size = len(held[0][0]) // 2  # keys that stay are not merged again with each row that follows
        if held:
            yield often(*merged(held))

    def merged(held: list) -> list[np.ndarray]:
        key, n, part = (np.concatenate(x) for x in zip(*held, strict=True))
        return _summed(key, (n, np.add), (part, np.minimum))

    def often(key: np.ndarray, n: np.ndarray, part: np.ndarray) -> pd.DataFrame:
        many = n >= least
        return pd.DataFrame({"key": key[many].view(np.int64), "mark": marks(key[many], part[many]).view(np.int64)})

    dealt = told.repartition(partitions(told.sparkSession), "block").sortWithinPartitions("block")
    return dealt.mapInPandas(run, "key long, mark long")


def pairs_of(arrays: DataFrame, filters: list, wanted) -> DataFrame:
    """``(key, a, b)``: the runs whose marks the filter ``wanted`` may hold, with the keys of what they are made of.

    So a key is told by one part of the arrays, not by each that has it.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [f.value for f in filters]
        held, size = [], 0
        for part in parts:
            for codes, hashes, number in zip(part["codes"], part["hashes"], part["part"], strict=True):
                a, b = safe_pairs(*read_back(codes, hashes), tables)
                key = combine(a, b)
                at = np.flatnonzero(known(wanted.value, marks(key, number)))
                at = at[np.unique(key[at], return_index=True)[1]]
                held.append((key[at], a[at], b[at]))
                size += len(at)
                if size > PAIRS_HELD:
                    held = [distinct(held)]
                    size = len(held[0][0])
                    if size > PAIRS_HELD // 2:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*distinct(held))

    def distinct(held: list) -> tuple[np.ndarray, ...]:
        key, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        first = np.unique(key, return_index=True)[1]
        return key[first], a[first], b[first]

    def rows(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": key.view(np.int64), "a": a.view(np.int64), "b": b.view(np.int64)})

    return arrays.select("codes", "hashes", "part").mapInPandas(run, "key long, a long, b long").distinct()


@F.pandas_udf(T.LongType())
def _combined(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(combine(a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64)).view(np.int64))


def candidates(arrays: DataFrame, words: DataFrame, total: int, folder: str, least: int, longest: int) -> list[DataFrame]:
    """``(lang, phrase, last, key)`` of the candidates of 2, 3, .. words; ``words`` are the frequent words likewise.

    ``total`` is the number of words of the corpus.
    """
    sc, blocks = words.sparkSession.sparkContext, blocks_of(total)
    filters, found, level = [], [], words
    try:
        for m in range(2, longest + 1):
            count = level.count()
            if not count:
                break
            filters.append(sc.broadcast(bloom(level, count)))  # FILTER_BITS / 8 bytes at most
            # Counts travel by key alone; what the few frequent keys are made of is looked up afterwards, in one part.
            often = stored(frequent_keys(pair_counts(arrays, filters, least, blocks), least, blocks), f"keys-{m}", folder)
            wanted = sc.broadcast(bloom(often.select(F.col("mark").alias("key")), often.count(), each=64))
            pairs = stored(pairs_of(arrays, filters, wanted).join(often, "key", "left_semi").select("a", "b"), f"pairs-{m}", folder)
            wanted.unpersist()
            first = level.select(F.col("key").alias("a"), "lang", "phrase")
            second = level.select(F.col("key").alias("b"), F.col("lang").alias("lang_b"), "last")
            named = pairs.join(first, "a").join(second, "b").filter("lang = lang_b")
            level = named.select("lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", _combined("a", "b").alias("key"))
            level = stored(level, f"candidates-{m}", folder)
            found.append(level)
    finally:
        for held in filters:
            held.unpersist()
    return found


TRIES = "shard int, words binary, base binary, check binary, accept binary, phrases array<struct<lang: string, phrase: string>>"


def built_tries(phrases: DataFrame, salt: int) -> DataFrame:
    """``TRIES``: one row for each shard of ``(shard, lang, phrase)``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        words = [p.split(" ") for p in rows["phrase"]]
        lengths = np.array([len(w) for w in words])
        raw = "\n".join(x for w in words for x in w).encode("utf-8", "surrogatepass") + b"\n"
        hashes = word_hashes(raw, SEPARATES)[2]
        langs = np.repeat(rows["lang"].to_numpy(), lengths)
        tokens = np.zeros(len(hashes), dtype=np.uint64)
        for lang in set(rows["lang"]):
            tokens[langs == lang] = salted(hashes[langs == lang], lang, salt)
        made = trie.build(tokens, lengths)
        told = [{"lang": a, "phrase": b} for a, b in zip(rows["lang"], rows["phrase"], strict=True)]
        parts = [x.tobytes() for x in (made.words, made.base, made.check, made.accept)]
        return pd.DataFrame([[int(rows["shard"].iloc[0]), *parts, told]], columns=["shard", "words", "base", "check", "accept", "phrases"])

    return phrases.groupBy("shard").applyInPandas(run, TRIES)


def summed_blocks(parts: DataFrame) -> DataFrame:
    """``(at, f)``: sums of the parts' counts ``(block, counts)``, block by block as a stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = None, None
        for batch in batches:
            for number, raw in zip(batch["block"], batch["counts"], strict=True):
                if number != block:
                    if block is not None:
                        yield rows(block, held)
                    block, held = number, np.zeros(len(raw) // 8, dtype=np.int64)
                held += np.frombuffer(raw, dtype=np.int64)
        if block is not None:
            yield rows(block, held)

    def rows(block: int, held: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(held)
        return pd.DataFrame({"at": at + block * COUNTS, "f": held[at]})

    return parts.repartition(partitions(parts.sparkSession), "block").sortWithinPartitions("block").mapInPandas(run, "at long, f long")


def counted(arrays: DataFrame, phrases: DataFrame, folder: str, longest: int, salt: int, most: int = TRIE_PHRASES) -> DataFrame:
    """``(lang, phrase, f)``: how often each of the phrases stands in the corpus, by one trie after the other."""
    spark = arrays.sparkSession
    total = phrases.count()
    shards = -(-total * 5 // (most * 4))  # a fifth of room, as the shards are dealt by hash
    dealt = phrases.withColumn("shard", F.expr(f"CAST(pmod(xxhash64(lang, phrase), {max(1, shards)}) AS INT)"))
    tries = stored(built_tries(dealt, salt), "tries", folder)
    sums = []
    for shard in range(shards):
        row = tries.filter(F.col("shard") == shard).select("words", "base", "check", "accept", F.size("phrases").alias("n")).first()
        if row is None:
            continue
        held = spark.sparkContext.broadcast((bytes(row.words), bytes(row.base), bytes(row.check), bytes(row.accept), row.n))

        def run(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            words, *tables, n = held.value
            made = trie.Trie(np.frombuffer(words, dtype=np.uint64), *[np.frombuffer(t, dtype=np.int32) for t in tables], n)
            counts = np.zeros(n, dtype=np.int64)
            for part in parts:
                for codes, hashes in zip(part["codes"], part["hashes"], strict=True):
                    codes, hashes = read_back(codes, hashes)
                    made.count(made.ids(hashes)[codes], longest, counts)
            blocks = [(k, counts[at : at + COUNTS].tobytes()) for k, at in enumerate(range(0, n, COUNTS)) if counts[at : at + COUNTS].any()]
            yield pd.DataFrame(blocks, columns=["block", "counts"])

        told = summed_blocks(arrays.select("codes", "hashes").mapInPandas(run, "block int, counts binary"))
        sums.append(stored(told.withColumn("shard", F.lit(shard)), f"sums-{shard}", folder))
        held.destroy()
    names = tries.select("shard", F.posexplode("phrases").alias("at", "p")).select("shard", F.col("at").cast("long").alias("at"), "p.lang", "p.phrase")
    if not sums:
        return spark.createDataFrame([], "lang string, phrase string, f long")
    all_sums = sums[0]
    for more in sums[1:]:
        all_sums = all_sums.unionByName(more)
    return names.join(all_sums, ["shard", "at"]).select("lang", "phrase", "f")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)``: the lowest-scoring cut of each of ``phrases``.

    ``phrases`` are frequent phrases ``(lang, phrase, f)``, ``words`` frequent words likewise, ``totals``
    ``(lang, n)``.  Products are decimals of 38 digits.
    """
    parts = phrases.unionByName(words)
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).select(
        "lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k")
    ).selectExpr("lang", "phrase", "a", "k", "array_join(slice(w, 1, k), ' ') AS first", "array_join(slice(w, k + 1, size(w)), ' ') AS rest")
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    score = "CAST((CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS BIGINT)"
    best = met.withColumn("score", F.expr(score)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def covered(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases ``(lang, phrase)`` that a longer one of ``(lang, phrase, f)`` holds with ``100 f(longer) >= percent f``.

    A longer phrase is no more frequent than those between it and what it holds, so phrases longer by one word tell.
    """
    w = F.split("phrase", " ")
    longer = phrases.filter(F.size(w) > 2).withColumn("w", w).select("lang", "f", F.explode(F.expr("array(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1))")).alias("part"))
    held = longer.select("lang", F.array_join("part", " ").alias("phrase"), F.col("f").alias("_f")).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    return phrases.join(held, ["lang", "phrase"]).filter(F.expr(f"100 * _f >= {percent} * f")).select("lang", "phrase")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, tries_of: int = TRIE_PHRASES
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    named = plain(docs, lang=lang, text=text).select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), text_of("text").alias("text"))
    arrays, vocabulary, salt = _read(named, folder)
    totals = stored(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "totals", folder)
    frequent = vocabulary.filter(F.col("n") >= least)
    words = stored(frequent.select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "key"), "frequent-words", folder)
    total = totals.agg(F.sum("n")).first()[0] or 0
    levels = candidates(arrays, words, total, folder, least, longest)
    if not levels:
        return _empty(spark)
    proposed = levels[0].select("lang", "phrase")
    for level in levels[1:]:
        proposed = proposed.unionByName(level.select("lang", "phrase"))
    phrases = counted(arrays, proposed.distinct(), folder, longest, salt, tries_of).filter(F.col("f") >= least)
    phrases = stored(phrases, "phrases", folder)
    kept = scored(phrases, frequent.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")), totals)
    kept = kept.join(covered(phrases), ["lang", "phrase"], "left_anti")
    return ranked(kept, top)


def _read(named: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """The arrays, the vocabulary ``(lang, word, key, n)``, and the salt with which no two words share a hash."""
    for salt in range(100):
        arrays = stored(encoded(named, salt).withColumn("part", F.spark_partition_id()), f"arrays-{salt}", folder)
        each = arrays.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
        summed = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
        vocabulary = stored(with_keys(summed, salt), f"vocabulary-{salt}", folder)
        if vocabulary.groupBy("key").count().filter("count > 1").isEmpty():
            return arrays, vocabulary, salt
    raise ValueError("words share hashes with every salt")


def ranked(scores: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language, first of each of many parts of it, then of those that are left."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(partitions(scores.sparkSession)))
    few = scores.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    last = few.filter(F.col("_r") <= top).withColumn("rank", rank).filter(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")


def op11_collocations(spark, sf: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf}/documents.parquet"))


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece
  FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (
  SELECT lang, len(r.g) AS m, array_to_string(r.g, ' ') AS phrase FROM (
    SELECT lang, unnest(list_concat(
      list_transform(range(1, len(w) + 1), lambda i: {'g': w[i:i]}), list_transform(range(1, len(w)), lambda i: {'g': w[i:i + 1]}),
      list_transform(range(1, len(w) - 1), lambda i: {'g': w[i:i + 2]}), list_transform(range(1, len(w) - 2), lambda i: {'g': w[i:i + 3]}),
      list_transform(range(1, len(w) - 3), lambda i: {'g': w[i:i + 4]}))) AS r FROM ws)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, t.n,
    (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM c, unnest(range(1, c.m)) AS u(k), f x, f y, total t
  WHERE x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    AND y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ') AND t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM c o WHERE o.lang = b.lang AND 100 * o.f >= 100 * b.a AND len(o.phrase) > len(b.phrase)
      AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= 2000
"""
