"""WARC archives with a two-level capture index.

Captures are sorted by URL key (host reversed, then path and query) and id, cut in ranges, and written as WARC 1.1
records, one gzip member each, one archive a range.  Next to an archive stand its index and its directory: the index
holds the sorted captures ``(key, id, offset, length)`` in compressed blocks, the directory the first capture and the
place of every block.  A look-up finds the archive and the block by binary search, range-reads the block's captures
and their stretch of the archive, and searches the block.

Of captures with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is a response and those
with larger ids are revisits that refer to it; repeated rows of the smallest id are all responses.  A revisit keeps
the payload's digest, and its length in the HTTP header, but not the payload.

Null payloads are empty, null URLs are the empty URL.  A null id sorts first, and is a revisit if a row with an id has
the same payload.  An empty table gives no archives and an empty result.  Archives are written under names of the
task attempt; only what the finished tasks report is read, so a lost task leaves nothing that counts.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overgrid.llm.common import partitions, plain, shared_folder, stored, text_of

#: A block of the index ends after so many captures or so many bytes of payload.
BLOCK_CAPTURES, BLOCK_BYTES = 512, 4 << 20
DATE = "2000-01-01T00:00:00Z"
URN = "urn:x-page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | Column) -> Column:
    """Host labels reversed and lower-cased, then port, path and query: ``https://a.b.c/x?y`` is ``c,b,a)/x?y``."""
    text = text_of(url)
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(.*)$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(text, pattern, 1)), r"\.")), ",")
    rest = F.split_part(F.regexp_extract(text, pattern, 2), F.lit("#"), F.lit(1))
    return F.when(text.rlike(pattern), F.concat(host, F.lit(")"), rest)).otherwise(text)


def filesystem(uri: str):
    """``(filesystem, path)`` of a shared folder; Hadoop's names of object stores are Arrow's without the letter a."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str, page_id: int | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record; a revisit's block is the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    safe = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the payload's digest is checked where there is a payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (digest_of(payload) != digest or len(payload) != length):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return {
        "page_id": _id(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "payload_bytes": length, "payload_digest": digest, "refers_to": _id(fields.get("WARC-Refers-To")), "payload": payload,
    }


def _id(urn: str | None) -> int | None:
    return None if urn is None or urn.endswith(":none>") else int(urn.strip("<>").removeprefix(URN))


def rank(page_id: int | None) -> int:
    """Ids in order, null before all."""
    return -(1 << 63) - 1 if page_id is None else int(page_id)


DIRECTORY = "archive string, first_key string, first_id long, last_key string, last_id long"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives of ``pages``; returns ``DIRECTORY``: the first and last capture of each archive."""
    named = plain(pages, page_id=page_id, url=url, payload=payload)
    named = named.select(
        F.col("page_id").cast("long").alias("page_id"), text_of("url").alias("url"), url_key("url").alias("key"),
        F.encode(text_of("payload"), "utf-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = named.filter(F.octet_length("payload") >= min_bytes).select("digest", "key", "page_id")
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "first", folder)
    later = large.join(first, "digest").filter("page_id > first OR page_id IS NULL").distinct()
    # What a capture refers to comes as a row of its own just before it: the payloads move once, by range.
    marks = later.select("key", "page_id", "digest", F.lit(False).alias("is_page"), F.lit("").alias("url"), F.lit(b"").alias("payload"), "first")
    rows = named.select("key", "page_id", "digest", F.lit(True).alias("is_page"), "url", "payload", F.lit(None).cast("long").alias("first"))
    order = ["key", "page_id", "digest"]
    spread = rows.unionByName(marks).repartitionByRange(partitions(pages.sparkSession), *order).sortWithinPartitions(*order, "is_page")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = None
        mark = None
        for part in parts:
            for key, page, digest, is_page, address, body, original in part.itertuples(index=False):
                page = None if pd.isna(page) else int(page)
                if not is_page:
                    mark = (key, page, digest, int(original))
                    continue
                archive = archive or Archive(folder)
                is_revisit = mark is not None and mark[:3] == (key, page, digest)
                archive.add(key, page, record(address, page, bytes(body), mark[3] if is_revisit else None, is_revisit))
        if archive:
            yield pd.DataFrame([archive.close()], columns=[c.split()[0] for c in DIRECTORY.split(", ")]).astype({"first_id": "Int64", "last_id": "Int64"})

    columns = ("key", "page_id", "digest", "is_page", "url", "payload", "first")
    return stored(spread.select(*columns).mapInPandas(write, DIRECTORY), "archives", folder)


class Archive:
    """One archive, its index and its directory, while they are written."""

    def __init__(self, folder: str):
        context = TaskContext.get()
        self.name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        self.fs, base = filesystem(f"{folder}/warc")
        self.fs.create_dir(base, recursive=True)
        self.base = f"{base}/{self.name}"
        self.records = self.fs.open_output_stream(self.base + ".warc.gz", compression=None)
        self.index = self.fs.open_output_stream(self.base + ".idx", compression=None)
        self.offset = self.index_offset = self.size = 0
        self.captures: list[tuple] = []
        self.blocks: list[tuple] = []
        self.ends: list[tuple] = []

    def add(self, key: str, page_id: int | None, raw: bytes) -> None:
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        self.records.write(member)
        self.captures.append((key, page_id, self.offset, len(member)))
        self.offset += len(member)
        self.size += len(raw)
        if len(self.captures) >= BLOCK_CAPTURES or self.size >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        packed = zlib.compress(json.dumps(self.captures).encode("utf-8", "surrogatepass"), 6)
        self.index.write(packed)
        key, page_id = self.captures[0][:2]
        self.blocks.append((key, page_id, self.index_offset, len(packed)))
        self.ends = [self.ends[0] if self.ends else self.captures[0][:2], self.captures[-1][:2]]
        self.index_offset += len(packed)
        self.captures, self.size = [], 0

    def close(self) -> tuple:
        if self.captures:
            self._end_block()
        self.records.close()
        self.index.close()
        with self.fs.open_output_stream(self.base + ".dir", compression=None) as out:
            out.write(zlib.compress(json.dumps(self.blocks).encode("utf-8", "surrogatepass"), 6))
        return (self.name, *self.ends[0], *self.ends[1])


class Reader:
    """Range reads from one archive; keeps the block that was read last."""

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(f"{folder}/warc")
        self.base = f"{base}/{name}"
        with self.fs.open_input_stream(self.base + ".dir", compression=None) as source:
            self.blocks = json.loads(zlib.decompress(source.read()))
        self.firsts = [order(key, page_id) for key, page_id, *_ in self.blocks]
        self.records = self.fs.open_input_file(self.base + ".warc.gz")
        self.index = self.fs.open_input_file(self.base + ".idx")
        self.at = -1

    def close(self) -> None:
        self.records.close()
        self.index.close()

    def _load(self, block: int) -> None:
        if block != self.at:
            _, _, offset, length = self.blocks[block]
            self.captures = json.loads(zlib.decompress(self.index.read_at(length, offset)))
            self.orders = [order(key, page_id) for key, page_id, *_ in self.captures]
            self.start = self.captures[0][2]
            stop = self.captures[-1][2] + self.captures[-1][3]
            self.stretch = self.records.read_at(stop - self.start, self.start)
            self.at = block

    def find(self, low: tuple, high: tuple) -> Iterator[dict]:
        """Records of the captures from ``low`` to ``high``, both included."""
        block = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while block < len(self.blocks) and self.firsts[block] <= high:
            self._load(block)
            for i in range(bisect.bisect_left(self.orders, low), bisect.bisect_right(self.orders, high)):
                _, _, offset, length = self.captures[i]
                member = self.stretch[offset - self.start : offset - self.start + length]
                yield parse(zlib.decompress(member, 31))
            block += 1


def order(key: str, page_id: int | None) -> tuple[bytes, int]:
    """Spark's order of ``(key, id)``."""
    return key.encode("utf-8", "surrogatepass"), rank(page_id)


FOUND = "key string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def look_up(spark: SparkSession, folder: str, directory: DataFrame, wanted: DataFrame, payloads: bool = True) -> DataFrame:
    """``FOUND``: every record of the captures ``(key, page_id)`` in ``wanted``; without ``page_id`` all of a key.

    The archives' bounds, two captures for each file, are held by every task; the rest is read where it is needed.
    """
    exact = "page_id" in wanted.columns
    bounds = sorted(
        (order(r.first_key, r.first_id), order(r.last_key, r.last_id), r.archive) for r in directory.toLocalIterator()
    )
    firsts, lasts, names = ([b[i] for b in bounds] for i in range(3))

    def ends(key: str, page_id) -> tuple[tuple, tuple]:
        if exact:
            one = order(key, None if pd.isna(page_id) else int(page_id))
            return one, one
        return order(key, None), (key.encode("utf-8", "surrogatepass"), 1 << 63)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = part["page_id"] if exact else [None] * len(part)
            rows = []
            for key, page_id in zip(part["key"], ids, strict=True):
                low, high = ends(key, page_id)
                for k in range(bisect.bisect_left(lasts, low), bisect.bisect_right(firsts, high)):
                    rows.append((names[k], key, None if pd.isna(page_id) else int(page_id)))
            yield pd.DataFrame(rows, columns=["archive", "key", "page_id"]).astype({"page_id": "Int64"})

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, rows, held = None, [], 0
        for part in parts:
            for name, key, page_id in part.itertuples(index=False):
                if reader is None or not reader.base.endswith(f"/{name}"):
                    if reader:
                        reader.close()
                    reader = Reader(folder, name)
                for found in reader.find(*ends(key, page_id)):
                    held += len(found["payload"])
                    rows.append((key, *(found[c] for c in columns[1:-1]), found["payload"] if payloads else None))
                    if held > BLOCK_BYTES:
                        yield framed(rows)
                        rows, held = [], 0
        if reader:
            reader.close()
        yield framed(rows)

    columns = [c.split()[0] for c in FOUND.split(", ")]

    def framed(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    asked = wanted.select("key", *(["page_id"] if exact else [])).distinct()
    routed = asked.mapInPandas(route, "archive string, key string, page_id long")
    spread = routed.repartition(partitions(spark), "archive").sortWithinPartitions("archive", "key", "page_id")
    return spread.mapInPandas(read, FOUND)


def op5_warc(spark, sf: str) -> DataFrame:
    """Writes the archives of all pages and looks every capture up again."""
    pages, folder = spark.read.parquet(f"{sf}/pages.parquet"), shared_folder(spark)
    directory = write_archives(pages, folder)
    wanted = pages.select(url_key("url").alias("key"), F.col("page_id").cast("long").alias("page_id"))
    found = look_up(spark, folder, directory, wanted, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
