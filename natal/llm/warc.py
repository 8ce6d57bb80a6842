"""WARC archives as seekable Zstandard bundles: written from pages, read back record by record.

Layout. A bundle is a file of independent Zstandard frames, each holding whole WARC records, and
ends with the seek table of the public seekable format (a skippable frame: sizes of all frames, their
number and a magic number at the very end), so plain ``zstd -d`` reads it as well. The index maps a
record id to (bundle, frame, offset in the frame, length). A reader fetches a frame's bytes only.

Writing. Every task writes bundles of its own under names no other attempt uses and returns the
index rows of what it wrote; Spark commits those rows once per task, so bundles of a lost or
doubled attempt are in no index and are never read.

Repeated payloads. Of the records with one payload of at least ``least`` bytes that with the smallest
page id is a ``response``, all others are ``revisit`` records, which hold HTTP headers and the
payload's digest but no payload. The smallest id per digest is a partial aggregate. It comes back
to the rows by a join on the digest: digests of more than one row in ``HOT_SHARE`` rows are at most
``HOT_SHARE`` in number and are broadcast, the others shuffle, and no key of those is heavy.

Cases: null html is an empty payload; a null page id counts as larger than any other; of repeated
rows with the smallest id one is the response, the rest revisit it; a payload whose rows all lack
an id refers to null; empty tables give empty archives; payloads of any length are one record in one
frame; a null url is left out of the record; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.llm.common import rows_of, tasks, written
from natal.session import scratch_path

#: Bytes of records in a frame, and of records in a bundle, at which the next one begins.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 3
#: Bytes of records that a task reads.
READ_BYTES = 256 << 20
#: Digests with more than one row in so many are broadcast, hence at most so many digests.
HOT_SHARE = 10_000
#: Fixed values of the seekable format and of the records.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, bundle string, frame int, offset bigint, length bigint"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Bundles


class BundleWriter:
    """Frames of records and, at the end, the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.held, self.size, self.total = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in it, length) of a record."""
        place = len(self.sizes), self.size, len(record)
        self.held.append(record)
        self.size += len(record)
        self.total += len(record)
        if self.size >= self.frame_bytes:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.held:
            frame = self.packer.compress(b"".join(self.held))
            self.out.write(frame)
            self.sizes.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number; only the seek table and the frames asked for are read."""

    def __init__(self, file):
        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        width = 12 if flags & 0x80 else 8  # with checksums or without
        file.seek(size - 9 - n * width)
        table = file.read(n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.file.seek(at)
        return self.unpacker.decompress(self.file.read(packed), max_output_size=plain)


# Records


def record_id(page_id, row: int) -> str:
    """Id of a record: the page id as text and the number of the row."""
    named = "" if page_id is None else "=" + urllib.parse.quote(str(page_id), safe="")
    return f"urn:page:{row}{named}"


def page_of(record: str | None) -> str | None:
    """The page id, as text, in a record id."""
    return urllib.parse.unquote(record.split("=", 1)[1]) if record and "=" in record else None


def make_record(name: str, url: str | None, payload: bytes, digest: str, size: int, refers: str | None) -> bytes:
    """A response with its payload or, with ``refers``, a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers else http + payload
    target = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else None
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        *([f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {PROFILE}"] if refers else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_digest(body)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def _fields(head: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode() for k, v in _FIELD.findall(head)}


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record; its lengths and digests are verified."""
    cut = data.index(b"\r\n\r\n") + 4
    if not data.startswith(VERSION.encode() + b"\r\n"):
        raise ValueError("no WARC record at this place")
    fields = _fields(data[:cut])
    body = data[cut : cut + int(fields["content-length"])]
    if data[cut + len(body) :] != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha1:{base32_digest(body)}":
        raise ValueError(f"record {fields.get('warc-record-id')} is damaged")
    split = body.index(b"\r\n\r\n") + 4
    http, payload = _fields(body[:split]), body[split:]
    if fields["warc-type"] == "response":
        if len(payload) != int(http["content-length"]) or fields["warc-payload-digest"] != f"sha1:{base32_digest(payload)}":
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    return fields, http, payload


# Writing


def _marked(pages: DataFrame, least: int) -> DataFrame:
    """Every page with its row number, payload digest and the record it refers to (row and id)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = written(
        pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row")).withColumns(
            {"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")}
        ),
        "warc-pages",
    )
    # Rows without an id come last; the row number decides between repeated rows.
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "row")
    groups = written(
        rows.filter(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"), "n"),
        "warc-groups",
    )
    share = (rows.count() // HOT_SHARE) + 1
    hot = groups.filter(F.col("n") > share).drop("n")  # HOT_SHARE rows at most
    cold = groups.filter(F.col("n") <= share).drop("n").withColumnsRenamed({"first_id": "cold_id", "first_row": "cold_row"})
    marked = rows.join(F.broadcast(hot), "digest", "left")
    # What is known to be a revisit by now leaves its payload behind before the shuffle.
    marked = marked.withColumn("payload", F.when(F.col("first_row").isNull() | (F.col("first_row") == F.col("row")), F.col("payload")))
    # Rows that found a hot group look for no other one, and a null key meets no other in one task.
    key = F.when(F.col("first_row").isNull() & (F.col("size") >= least), F.col("digest"))
    cold = cold.withColumnRenamed("digest", "cold_digest")
    number = "pmod(xxhash64(row), 65536)"
    marked = marked.withColumn("join_key", F.coalesce(key, F.expr(f"concat('-', {number})")))
    marked = marked.join(cold, marked["join_key"] == cold["cold_digest"], "left")
    first_row = F.coalesce("first_row", "cold_row")
    refers = first_row.isNotNull() & (first_row != F.col("row"))
    first_id = F.when(F.col("first_row").isNotNull(), F.col("first_id")).otherwise(F.col("cold_id"))
    return marked.select(
        "page_id",
        "row",
        "url",
        "digest",
        "size",
        F.when(~refers, F.col("payload")).alias("payload"),
        F.when(refers, first_id).alias("to_id"),
        F.when(refers, first_row).alias("to_row"),
    )


def write_archives(pages: DataFrame, uri: str, least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per page below ``uri``; returns the index, itself a written table."""
    rows = _marked(pages, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(uri)
        files.create_dir(root, recursive=True)
        bundle = name = None
        for batch in batches:
            places = []
            for r in (row for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist()):
                if bundle is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(files.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                own = record_id(r["page_id"], r["row"])
                refers = None if r["to_row"] is None else record_id(r["to_id"], r["to_row"])
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                record = make_record(own, r["url"], r["payload"] or b"", digest, r["size"], refers)
                places.append((own, name, *bundle.add(record)))
                if bundle.total >= bundle_bytes:
                    bundle.close()
                    bundle = None
            yield _table(places, INDEX_SCHEMA)
        if bundle is not None:
            bundle.close()

    return written(rows.mapInArrow(run, INDEX), "warc-index")


INDEX_SCHEMA = pa.schema(
    [("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


# Reading

RECORDS = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("refers_to", pa.string()),
        ("payload", pa.binary()),
    ]
)
RECORDS_DDL = (
    "record_id string, record_type string, url string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"
)


def read_records(index: DataFrame, uri: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, each verified against its digests.

    Rows of one frame go to one task next to each other, so a frame is unpacked once and no other
    frame is read. ``payloads=False`` leaves the payload null (it is verified all the same).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(uri)

        @lru_cache(maxsize=4)
        def reader(bundle: str) -> BundleReader:
            return BundleReader(files.open_input_file(f"{root}/{bundle}"))

        @lru_cache(maxsize=1)
        def frame(bundle: str, number: int) -> bytes:
            return reader(bundle).frame(number)

        for batch in batches:
            found, size = [], 0
            columns = [batch.column(c) for c in INDEX_SCHEMA.names]
            for at in range(0, batch.num_rows, 256):
                for name, bundle, number, offset, length in zip(*(c.slice(at, 256).to_pylist() for c in columns)):
                    fields, http, payload = parse_record(frame(bundle, number)[offset : offset + length])
                    found.append(
                        (
                            fields["warc-record-id"].strip("<>"),
                            fields["warc-type"],
                            fields.get("warc-target-uri"),
                            fields["warc-payload-digest"].removeprefix("sha1:"),
                            int(http["content-length"]),
                            fields.get("warc-refers-to", "").strip("<>") or None,
                            payload if payloads and fields["warc-type"] == "response" else None,
                        )
                    )
                    size += length if payloads else 0
                    if size > 8 * FRAME_BYTES:
                        yield _table(found, RECORDS)
                        found, size = [], 0
            yield _table(found, RECORDS)

    # Sized by the records, of which the index rows that are shuffled show nothing.
    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(tasks(index.sparkSession), size // READ_BYTES)
    spread = index.repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return spread.select(*INDEX_SCHEMA.names).mapInArrow(run, RECORDS_DDL)


def archive_report(pages: DataFrame, uri: str | None = None, least: int = 0) -> DataFrame:
    """The query's columns: what the archives hold of every page, read back from them."""
    uri = uri or scratch_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType
    page = lambda column: F.url_decode(F.get(F.split(column, "=", 2), F.lit(1))).cast(kind)
    return read_records(write_archives(pages, uri, least), uri, payloads=False).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def seek_tables(uri: str, bundles: Iterable[str]) -> dict[str, list[tuple[int, int, int]]]:
    """(start, packed size, plain size) of the frames of some bundles."""
    files, root = pafs.FileSystem.from_uri(uri)
    return {b: BundleReader(files.open_input_file(f"{root}/{b}")).frames for b in bundles}
