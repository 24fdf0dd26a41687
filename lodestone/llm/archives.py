"""Legacy archives: ARC files in, WARC files out, and WARC files read back.

An ARC file opens with a version block whose second line tells the version;
each record opens with a line of that version's fields (five in version 1, ten
in version 2) whose last is the declared length of what follows. Records are
taken by declared length, never by searching, and become WARC records: the
capture time as an ISO date, an identifier made from the record and its place,
and SHA-1 digests of block and payload. The type is synthesised: the version
block becomes a warcinfo record, what holds an HTTP response a response (or a
revisit, by the decision on equal payloads), anything else a resource of its
own media type.

Of records with equal payloads of at least REVISIT_BYTES the one with the
largest page id is a response and the others revisit it. The decisions come
from a table of digests that occur more than once, pre-aggregated and joined;
payloads are not shuffled where that table is small.

Defined cases: a null payload is empty; a null url is empty and written as
"-"; characters that a header line can't hold are percent-encoded; a null page
id is never the largest, and is a response unless another page holds the same
payload; rows that repeat the largest page id are all responses, and revisits
name the last of them; no two records share an identifier; a payload of any
length that a row can hold is one record; an archive to be converted must fit a
row (2 GB); without rows there are no files and the result is empty; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha1
from io import BytesIO
from urllib.parse import quote
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, map_batches, read_blobs, shared_path, tune, write_blobs

#: Of the contract: the least payload that is revisited.
REVISIT_BYTES = 1000
#: Bytes of a WARC file before compression, capture time of pages that have none, level of compression.
FILE_BYTES, CAPTURED, LEVEL = 16 << 20, "20260101000000", 4
#: Fixed by the ARC formats: fields of a record's line.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
_TITLES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_END_OF_FILE = gzip.compress(b"", mtime=0)  # an empty member; its last byte is zero


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers (names in lower case) and payload of the captured response; no header if it has none."""
        if not self.block.startswith(b"HTTP/"):
            return {}, self.block
        head, _, payload = self.block.partition(b"\r\n\r\n")
        lines = (x.partition(b":") for x in head.split(b"\r\n")[1:])
        return {a.strip().lower().decode("latin-1"): b.strip().decode("latin-1") for a, _, b in lines}, payload


def write_arc(pages: Iterable[tuple[int | None, str | None, bytes]], version: int = 1, name: str = "pages") -> bytes:
    """An ARC file of (page id, url, payload)."""
    title = f"{version} 0 lodestone\n{_TITLES[version]}\n".encode()
    own = {"url": f"filedesc://{name}.arc", "ip": "0.0.0.0", "date": CAPTURED, "mime": "text/plain", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": f"{name}.arc", "length": str(len(title))}
    out = [" ".join(own[f] for f in FIELDS[version]).encode(), b"\n", title]
    at = sum(map(len, out))
    for page, url, payload in pages:
        ids = b"" if page is None else b"X-Page-Id: %d\r\n" % page
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (ids, len(payload), payload)
        own |= {"url": quote(url or "-", safe="!#$%&'()*+,/:;=?@[]~-._"), "ip": "127.0.0.1", "mime": "text/html", "offset": str(at), "length": str(len(block)), "checksum": str(zlib.crc32(block))}
        line = b"\n" + " ".join(own[f] for f in FIELDS[version]).encode() + b"\n"
        out += [line, block]
        at += len(line) + len(block)
    out.append(b"\n")
    return b"".join(out)


def read_arc(content: bytes, info: bool = False) -> Iterator[ArcRecord]:
    """The records of an ARC file, plain or gzipped member by member; its version block too if wanted."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, version = 0, 0
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"an ARC record line without an end at byte {at}")
        parts = content[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        if not version:
            version = int(content[end + 1 : end + 2])  # the line after the first tells the version
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
        names = FIELDS[version]
        extra = len(parts) - len(names)  # blanks within the url
        if extra < 0:
            raise ValueError(f"an ARC record line with {len(parts)} fields at byte {at}")
        fields = dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True))
        size = int(fields["length"])
        block = content[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"an ARC record shorter than declared at byte {at}")
        at = end + 1 + size
        if info or not fields["url"].startswith("filedesc:"):
            yield ArcRecord(version, fields, block)


def record_id(*key: object) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, ' '.join(map(str, key)))}>"


def kind_of(arc: ArcRecord) -> tuple[str, str]:
    """WARC type and media type of an ARC record."""
    if arc.fields["url"].startswith("filedesc:"):
        return "warcinfo", "application/warc-fields"
    if arc.block.startswith(b"HTTP/"):
        return "response", "application/http; msgtype=response"
    return "resource", arc.fields["mime"]


def to_warc(arc: ArcRecord, place: object, refers_to: tuple[int, object] | None = None) -> bytes:
    """The WARC record of an ARC record at a place of its own (part of its identifier): a revisit if it refers to a page (its id and place), else by its kind."""
    headers, payload = arc.http
    kind, media = kind_of(arc)
    d = arc.fields["date"].ljust(14, "0")
    lines = [f"WARC-Record-ID: {record_id(place)}", f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"]
    if kind == "warcinfo":
        name = arc.fields["url"].partition("//")[2]
        block = f"software: lodestone\r\nformat: WARC file version 1.1\r\nsource: {name}\r\nsource-format: ARC version {arc.version}\r\n".encode()
        lines += [f"WARC-Filename: {name}"]
    else:
        block = arc.block if refers_to is None else arc.block[: len(arc.block) - len(payload)]
        kind = kind if refers_to is None else "revisit"
        lines += [
            f"WARC-Target-URI: {arc.fields['url']}",
            f"WARC-IP-Address: {arc.fields['ip']}",
            f"WARC-Payload-Digest: sha1:{b32encode(sha1(payload).digest()).decode()}",
            f"WARC-Payload-Length: {len(payload)}",
        ]
        if "x-page-id" in headers:
            lines.append(f"X-Page-Id: {headers['x-page-id']}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to[1])}", f"X-Refers-To-Page-Id: {refers_to[0]}"]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *lines, f"WARC-Block-Digest: sha1:{b32encode(sha1(block).digest()).decode()}", f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by declared length."""
    stream = gzip.GzipFile(fileobj=BytesIO(content)) if content[:2] == b"\x1f\x8b" else BytesIO(content)
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("a WARC record shorter than declared")
        yield headers, block


def decisions(pages: DataFrame) -> DataFrame:
    """(digest, keeper): for payloads that occur more than once, the page that the others revisit and its place."""
    payload = F.coalesce(F.col("payload"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "place", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= REVISIT_BYTES)
    found = rows.groupBy("digest").agg(F.max(F.struct("page_id", "place")).alias("keeper"), F.count("*").alias("n"))
    return found.where("n > 1 and keeper.page_id is not null").select("digest", "keeper")


def _bundles(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Records as gzip members, gathered to files."""
    held, room = [], 0
    for record in records:
        held.append(gzip.compress(record, LEVEL, mtime=0))
        room += len(record)
        if room >= FILE_BYTES:
            yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held) + _END_OF_FILE], pa.binary())})
            held, room = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held) + _END_OF_FILE], pa.binary())})


def pages_to_warc(pages: DataFrame, path: str, version: int = 2) -> None:
    """WARC files of (page_id, url, payload binary): each batch of pages becomes an ARC file, which is parsed and converted."""
    pages = pages.withColumn("place", F.monotonically_increasing_id())  # the same in both scans of a table
    decided = cut(decisions(pages), "decisions")
    payload = F.coalesce(F.col("payload"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "url", payload.alias("payload"), "place", F.sha1(payload).alias("digest")).join(decided, "digest", "left")
    again = F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper.page_id"))
    rows = rows.select("page_id", "url", "payload", "place", F.when(again, F.col("keeper.page_id")).alias("refers_to"), F.when(again, F.col("keeper.place")).alias("there"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for a in range(0, batch.num_rows, 64):
                    part = batch.slice(a, 64)
                    archive = write_arc(zip(*(part.column(k).to_pylist() for k in range(3)), strict=True), version)
                    for arc, place, refers_to, there in zip(read_arc(archive), *(part.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                        yield to_warc(arc, f"page {place}", None if refers_to is None else (refers_to, f"page {there}"))

        yield from _bundles(records())

    write_blobs(map_batches(rows, convert, "value binary"), path)


def convert_archives(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """ARC files of a folder to WARC files, every record as captured, and a warcinfo record for each file."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for k in range(batch.num_rows):
                    path = batch.column(1)[k].as_py()
                    yield from (to_warc(arc, f"{path} {n}") for n, arc in enumerate(read_arc(batch.column(0)[k].as_py(), info=True)))

        yield from _bundles(records())

    files = tune(spark).read.format("binaryFile").load(arc_path).select("content", "path")
    write_blobs(map_batches(files, convert, "value binary"), warc_path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record but warcinfo: page_id, url, record_id, date, payload_bytes, payload_digest (hex), record_type, refers_to; digests of payloads that are there are taken anew and must agree."""
    schema = "page_id long, url string, record_id string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for headers, block in read_warc(batch.column(0)[k].as_py()):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    digest, size = b32decode(headers["warc-payload-digest"][5:]).hex(), int(headers["warc-payload-length"])
                    if headers["warc-type"] != "revisit":
                        payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                        if (sha1(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"digest or length of {headers['warc-record-id']} is wrong")
                    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    rows.append((page and int(page), headers["warc-target-uri"], headers["warc-record-id"], headers["warc-date"], size, digest, headers["warc-type"], refers and int(refers)))
                names = [c.split()[0] for c in schema.split(", ")]
                kinds = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return map_batches(read_blobs(tune(spark), path).select("content"), parse, schema)


def round_trip(pages: DataFrame, version: int = 2) -> DataFrame:
    """Write every page (page_id, url, html) and read the archives back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    pages_to_warc(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("payload")), path, version)
    return read_archives(spark, path)
