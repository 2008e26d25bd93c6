"""Byte-level BPE encoding and decoding by DuckDB queries inside each task.

The text is cut by the tokenizer's pattern.  A word that is a token is that token.  The others become rows (word,
position, token), one for each byte; a recursive query joins neighbours with the merge table and contracts each
word's leftmost pair of least rank until no word has one.  A query takes as many words as the rows of all its rounds
allow, so long words come in small numbers.  A worker encodes a word once and remembers it, within a bound of bytes; what
it has learnt serves its next tasks too, and goes when none follows.  Words of more than ``LONG_WORD`` bytes would need as many rounds as they have bytes,
each over all of them; a heap does the same merges for them.  Decoding joins the ids of a batch of documents with the
vocabulary and aggregates the bytes by position.

The merge table follows from the rank file: every cut of a token into two tokens.  Null texts are empty; an empty
text has no tokens and decodes to an empty text.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import threading
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_WORD = 64
#: Bounds of one query: rows of all rounds of encoding, tokens decoded; and bytes of words that a worker remembers, twice.
ROWS_AT_ONCE = 600_000
TOKENS_AT_ONCE = 400_000
REMEMBERED = 40_000_000
#: Texts that are encoded, decoded and sent back in one go: rows, and bytes unless one text has more.
ROWS_OF_TEXT = 512
BYTES_AT_ONCE = 4_000_000
#: What a remembered word takes besides its own bytes and ids.
ENTRY = 200

ENCODE = """with recursive t(step, w, pos, tok) as (
  select 0, w, pos, tok from start
  union all
  select step + 1, w, pos - (pos > spot)::int, case when pos = spot then rank else tok end
  from (select l.step, l.w, l.pos, l.tok, (best.code // 65536)::int as rank, (best.code % 65536)::int as spot
    from t l join (
      select a.w, min(m.rank::bigint * 65536 + a.pos) as code
      from t a join t b on b.w = a.w and b.pos = a.pos + 1 join merges m on m.a = a.tok and m.b = b.tok
      group by a.w) best on best.w = l.w) s
  where pos <> spot + 1)
select t.w, t.tok from t join (select w, max(step) as step from t group by w) z on z.w = t.w and z.step = t.step
order by t.w, t.pos"""

DECODE = "select d, string_agg(hex, '' order by p) as hex from tokens join vocabulary using (id) group by d"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """One task's encoder and decoder over its own in-memory database."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.known, self.before, self.held = {}, {}, 0  # ids of words, those known before the last turn, bytes of the first
        self.base = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.db.register("_v", pa.table({"id": list(ranks.values()), "hex": [t.hex() for t in ranks]}))
        self.db.execute("create table vocabulary as select id::int as id, hex from _v")
        self.db.execute(  # every cut of a token into two tokens
            """create table merges as select a.id as a, b.id as b, t.id as rank
            from (select id, hex, unnest(range(2, length(hex), 2)) as cut from vocabulary where length(hex) > 2) t
            join vocabulary a on a.hex = t.hex[:cut] join vocabulary b on b.hex = t.hex[cut + 1:]"""
        )

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(text or "") for text in texts]
        if self.held > REMEMBERED:  # what is not asked for again until the next turn is forgotten
            self.known, self.before, self.held = {}, self.known, 0
        self._learn(set(chain.from_iterable(cut)).difference(self.known))
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def _learn(self, words: set[str]) -> None:
        short: list[tuple[str, bytes]] = []
        for word in words:
            ids = self.before.get(word)
            if ids is None:
                raw = word.encode("utf-8")
                rank = self.ranks.get(raw)
                if rank is not None:
                    ids = rank.to_bytes(4, "little")
                elif len(raw) > LONG_WORD:
                    ids = np.array(merge_by_heap(raw, self.ranks), dtype="<u4").tobytes()
                else:
                    short.append((word, raw))
                    continue
            self._keep(word, ids)
        # A word of n bytes has n rows in the first round and one less in each of the next.
        short.sort(key=lambda pair: len(pair[1]))
        some, rows = [], 0
        for pair in short:
            own = len(pair[1]) * (len(pair[1]) + 1) // 2
            if some and rows + own > ROWS_AT_ONCE:
                self._contract(some)
                some, rows = [], 0
            some.append(pair)
            rows += own
        if some:
            self._contract(some)

    def _keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.held += ENTRY + len(word) + len(ids)

    def _contract(self, words: list[tuple[str, bytes]]) -> None:
        lengths = np.array([len(raw) for _, raw in words])
        data = np.frombuffer(b"".join(raw for _, raw in words), dtype=np.uint8)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        start = {"w": np.repeat(np.arange(len(words)), lengths).astype(np.int32), "pos": (np.arange(len(data)) - first).astype(np.int32), "tok": self.base[data]}
        self.db.register("start", pa.table(start))
        found = self.db.execute(ENCODE).fetchnumpy()
        self.db.unregister("start")
        ids = np.asarray(found["tok"]).astype("<u4")
        cuts = np.searchsorted(np.asarray(found["w"]), np.arange(len(words) + 1))
        for (word, _), a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
            self._keep(word, ids[a:b].tobytes())

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        out: list[bytes] = []
        at = 0
        while at < len(encoded):
            upto, held = at, 0
            while upto < len(encoded) and (held == 0 or held + len(encoded[upto]) // 4 <= TOKENS_AT_ONCE):
                held += len(encoded[upto]) // 4
                upto += 1
            out.extend(self._decode(encoded[at:upto]))
            at = upto
        return out

    def _decode(self, encoded: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int32)
        lengths = np.array([len(e) // 4 for e in encoded])
        tokens = {"d": np.repeat(np.arange(len(encoded)), lengths).astype(np.int32), "p": np.arange(len(ids), dtype=np.int32), "id": ids}
        self.db.register("tokens", pa.table(tokens))
        found = dict(self.db.execute(DECODE).fetchall())
        self.db.unregister("tokens")
        return [bytes.fromhex(found.get(d, "")) for d in range(len(encoded))]


def merge_by_heap(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, leftmost least rank first, in n log n for one long word."""
    parts: list[bytes | None] = [raw[i : i + 1] for i in range(len(raw))]
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts):
            rank = ranks.get(parts[i] + parts[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, len(parts[i]) + len(parts[j])))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p in parts if p is not None]


#: Seconds after its last task that a worker keeps what it has learnt; other stages then have the memory.
KEPT_S = 3.0
_CODERS: dict[tuple[int, str], Coder] = {}
_TIMERS: list[threading.Timer] = []


def coder_of(ranks: dict[bytes, int], pattern: str) -> Coder:
    """The worker's coder for these ranks."""
    while _TIMERS:
        _TIMERS.pop().cancel()
    key = (hash(frozenset(ranks.items())), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(ranks, pattern)
    return _CODERS[key]


def forget_soon() -> None:
    """Drop the worker's coder unless another task asks for it within a few seconds."""
    timer = threading.Timer(KEPT_S, _CODERS.clear)
    timer.daemon = True
    _TIMERS.append(timer)
    timer.start()


ENCODED = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", column: str = "bpe") -> DataFrame:
    """``docs`` with a struct column ``(n_tokens, ids, decoded)``; ids are little-endian unsigned 32-bit integers.

    The rank file is read on the driver and sent to the workers (its size is that of a vocabulary).
    """
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf(ENCODED)
    def coded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = coder_of(held.value, pattern)
        for part in parts:
            for some in slices(part):
                yield coder_rows(coder, some.to_pylist())
        forget_soon()

    return docs.withColumn(column, coded(F.col(f"`{text}`")))


def slices(part: pa.Array) -> Iterator[pa.Array]:
    """A batch's rows in runs whose results alone are held: Spark's batches are bounded in rows, not in bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(part):
        most = BYTES_AT_ONCE + (int(sizes[at - 1]) if at else 0)
        upto = min(at + ROWS_OF_TEXT, max(at + 1, int(np.searchsorted(sizes, most, side="right"))))
        yield part.slice(at, upto - at)
        at = upto


def coder_rows(coder: Coder, texts: list[str | None]) -> pa.Array:
    ids = coder.encode(texts)
    columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(coder.decode(ids), pa.binary())]
    return pa.StructArray.from_arrays(columns, [f.name for f in ENCODED])


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    coded = encode(docs.select("doc_id", "text"), ranks_path, pattern)
    return coded.select(
        "doc_id", F.col("bpe.n_tokens").alias("n_tokens"),
        F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark, sf: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
