"""WARC archives with a two-level capture index.

Records are gzip members in ``.warc.gz`` form, written by Spark's text writer with an empty gzip member as the line
separator, so the files are plain concatenations of members in any store that Spark writes to. Reading an archive
gives one capture per record. Captures are globally sorted by their URL key with reversed host and packed into
compressed blocks of CDXJ lines; a sparse directory holds the first key of every block. A lookup binary-searches the
directory, then the block, then reads one byte range of one archive. Blocks grow with the number of captures, so the
directory has at most about ``DIRECTORY`` entries and may be collected or broadcast.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import math
import re
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windvane.llm.common import saved, shared_folder

BLOCK = 3000
DIRECTORY = 200_000
RECORDS_PER_FILE = 4000
SALTS = 16
FEED = 1 << 14
#: An empty gzip member, as the characters whose Latin-1 bytes it is.
SEPARATOR = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_EMPTY = SEPARATOR.encode("latin-1")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, length long"


def url_key(url: str | None) -> str:
    """The URL without scheme, user, port and fragment, host reversed: ``http://a.b.org:80/x#y`` is ``org,b,a)/x``."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "").partition("#")[0]
    host, _, path = re.match(r"([^/?]*)(/?)(.*)", rest, re.DOTALL).groups()
    host = host.rpartition("@")[2].partition(":")[0].lower()
    return ",".join(reversed(host.split("."))) + ")/" + path


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest())}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record as a gzip member; a revisit holds the HTTP header of the full payload only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'urn:unknown'}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def write_archives(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", body_column: str = "html", date: str = "2024-01-01T00:00:00Z") -> str:
    """Write a record per page; of records with equal payloads the one with the largest id is the response. Returns the folder.

    NULL bodies are empty payloads. NULL ids come after all others (they revisit, unless all ids of a payload are
    NULL: then all are responses). Rows that repeat the response's id and payload are responses too. NULL URLs are
    written as ``urn:unknown``.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(body_column).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumns({"sha1": F.sha1("body"), "size": F.octet_length("body"), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))})
    groups = rows.groupBy("sha1", "size").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Groups are repeated for every salt, so that a payload of very many pages is spread over tasks.
    groups = groups.select("sha1", "size", "response", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    placed = rows.join(groups, ["sha1", "size", "salt"], "left")
    placed = placed.select("page_id", "url", "body", "sha1", "response", F.coalesce(~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull(), F.lit(False)).alias("revisit"))

    def records(batches):
        for batch in batches:
            out = []
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page_id, url, body, sha1, response, revisit = (c[i].as_py() for c in columns)
                out.append(record(page_id, url, body.encode("utf-8", "surrogatepass"), _base32(sha1), response, revisit, date))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    folder = shared_folder(pages.sparkSession, "warc")
    written = placed.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    written.write.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)
    return folder


def _members(content: memoryview):
    """(offset, length, decompressed bytes) of every non-empty gzip member."""
    at = 0
    while at < len(content):
        if content[at : at + len(_EMPTY)] == _EMPTY:
            at += len(_EMPTY)
            continue
        unpacker, parts, to = zlib.decompressobj(31), [], at
        while not unpacker.eof and to < len(content):
            parts.append(unpacker.decompress(content[to : to + FEED]))
            to += FEED
        end = min(to, len(content)) - len(unpacker.unused_data)
        if data := b"".join(parts):
            yield at, end - at, data
        at = end


def parse_record(data: bytes) -> dict:
    """Header fields (lower-case names), ``block`` and ``payload`` of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(": "), "") for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"block": block, "payload": payload, "full_length": int(re.search(rb"Content-Length: (\d+)", http)[1])}


def _capture(path: str, offset: int, length: int, data: bytes) -> tuple:
    found = parse_record(data)
    kind, digest = found["warc-type"], found["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        own = base64.b32encode(hashlib.sha1(found["payload"]).digest()).decode()
        if own != digest or len(found["payload"]) != found["full_length"]:
            raise ValueError(f"damaged record in {path} at {offset}")
    number = lambda name: int(found[name]) if found.get(name) else None
    return number("x-page-id"), found["warc-target-uri"], found["full_length"], digest, kind, number("x-refers-to-page"), path, offset, length


def _read(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.string())])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = [_capture(path, *member) for member in _members(memoryview(content.as_buffer()).cast("B"))]
            rows = [(*r, url_key(r[1])) for r in rows]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One capture per record, digests checked against the payloads. A file of a bounded number of records is one task's step."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(_read, f"{_CAPTURE}, key string")


@dataclass
class CaptureIndex:
    """Compressed blocks of captures in key order, and the directory of their first keys."""

    blocks: DataFrame

    @classmethod
    def build(cls, captures: DataFrame) -> CaptureIndex:
        captures = saved(captures, "captures")
        size = max(BLOCK, math.ceil(captures.count() / DIRECTORY))
        order = ["key", "page_id", "path", "offset"]

        def pack(batches):
            held: list = []

            def block(rows):
                lines = "\n".join(f"{r['key']} {json.dumps({k: v for k, v in r.items() if k != 'key'})}" for r in rows)
                return pa.RecordBatch.from_arrays(
                    [pa.array([rows[0]["key"]]), pa.array([rows[-1]["key"]]), pa.array([len(rows)], pa.int64()), pa.array([zlib.compress(lines.encode(), 1)], pa.binary())],
                    names=["first_key", "last_key", "n", "data"],
                )

            for batch in batches:
                held += batch.to_pylist()
                while len(held) >= size:
                    yield block(held[:size])
                    held = held[size:]
            if held:
                yield block(held)

        packed = captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "first_key string, last_key string, n long, data binary")
        return cls(saved(packed.withColumn("block", F.monotonically_increasing_id()), "blocks"))

    def captures(self, blocks: DataFrame | None = None) -> DataFrame:
        """The captures of some or all blocks, decoded in tasks."""

        def unpack(batches):
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    lines = [line.split(" ", 1) for line in zlib.decompress(data).decode().split("\n")]
                    yield pa.RecordBatch.from_pylist([json.loads(rest) | {"key": key} for key, rest in lines], schema)

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.string())])
        return (self.blocks if blocks is None else blocks).select("data").mapInArrow(unpack, f"{_CAPTURE}, key string")

    def directory(self) -> list[tuple[str, str, int]]:
        """First key, last key and number of every block, in order."""
        return sorted((r["first_key"], r["last_key"], r["block"]) for r in self.blocks.select("first_key", "last_key", "block").collect())

    def lookup(self, url: str) -> list[dict]:
        """All captures of a URL: binary search in the directory, then only the blocks that may hold it."""
        key, entries = url_key(url), self.directory()
        first = bisect.bisect_left([e[1] for e in entries], key)
        last = bisect.bisect_right([e[0] for e in entries], key)
        wanted = [e[2] for e in entries[first:last]]
        found = self.captures(self.blocks.filter(F.col("block").isin(wanted))).filter(F.col("key") == key) if wanted else None
        return [r.asDict() for r in found.collect()] if found is not None else []

    def lookup_all(self, urls: DataFrame, url_column: str = "url") -> DataFrame:
        """Captures of many URLs (rows ``asked`` and capture columns): keys find their blocks in the broadcast directory; only those are decoded."""
        entries = urls.sparkSession.sparkContext.broadcast(self.directory())

        def place(batches):
            firsts, lasts = [e[0] for e in entries.value], [e[1] for e in entries.value]
            for batch in batches:
                rows = []
                for url in batch.column(0).to_pylist():
                    key = url_key(url)
                    rows += [(url, key, e[2]) for e in entries.value[bisect.bisect_left(lasts, key) : bisect.bisect_right(firsts, key)]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["asked", "key", "block"])

        placed = saved(urls.select(F.col(url_column).cast("string").alias("asked")).distinct().mapInArrow(place, "asked string, key string, block long"), "asked")
        needed = self.blocks.join(placed.select("block").distinct(), "block", "left_semi")
        return placed.select("asked", "key").distinct().join(self.captures(needed), "key").drop("key")


def read_range(spark: SparkSession, path: str, offset: int, length: int) -> dict:
    """One record, read from its byte range through the store's own client."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(offset)
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()
    return parse_record(zlib.decompress(data, 31))


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back, index them, and return what the index says of every page.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. An empty table gives no rows.
    """
    index = CaptureIndex.build(read_archives(pages.sparkSession, write_archives(pages)))
    return index.captures().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
