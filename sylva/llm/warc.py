"""Legacy web archives (ARC, versions 1 and 2) converted to WARC 1.1, with revisit records for equal payloads.

An ARC archive opens with a version block whose second line names the version and whose third line names the fields
of the header line of every record. parse_arc() follows these and the declared lengths; nothing is searched for in
content. to_warc() then makes the record that an archive in WARC form would have had: identifier, timestamp, type,
digests. Archives, plain or gzipped by record, are independent of each other. WARC files hold one gzip member a record,
and a warcinfo record before each run of CHUNK_BYTES.

A record's key is the number in its own X-Page-ID header; a record without one has a null key.

Nulls: a null payload is empty, a null url is "urn:none", a null id stays null and never is the response of others.
Repeated rows: rows that share the largest id of their payload are responses all. Payloads of any length are one record;
one that is longer than CHUNK_BYTES is a run of its own. Extra columns are ignored whatever their names. An empty table
gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header fields of the two ARC versions, and the revisit profile of WARC 1.1.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of content after which the next ARC archive is begun.
ARCHIVE_BYTES = 4 << 20
#: Bytes of records, compressed, after which the next run begins, and runs in one WARC file at most.
CHUNK_BYTES, FILE_CHUNKS = 8 << 20, 16
#: Payloads that repeat, in one broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of an archive that are given to the decompressor first; what it doesn't need is copied.
WINDOW = 2 << 10
CAPTURED = "20240101000000"


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    content: bytes
    version: int


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(name: str, version: int, records: Iterable[tuple[str, bytes]]) -> bytes:
    """A legacy archive with one text/html record for each (url, content)."""
    about = f"{version} 0 sylva\n{FIELDS[version]}\n\n".encode()
    out, at = [], 0

    def put(url: str, mime: str, content: bytes) -> None:
        nonlocal at
        fields = [url, "0.0.0.0", CAPTURED, mime] + ([] if version == 1 else ["200", "-", "-", str(at), name]) + [str(len(content))]
        block = " ".join(fields).encode() + b"\n" + content + (b"\n" if at else b"")
        out.append(block)
        at += len(block)

    put(f"filedesc://{name}", "text/plain", about)
    for url, content in records:
        put(url, "text/html", content)
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an archive, the version block left out. Header lines are cut from the right, so that a url may hold spaces."""
    at, names, version = 0, FIELDS[1].split(), 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # the line feed after a record
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        if not version:
            length = int(line.rsplit(" ", 1)[1])
            about = data[end + 1 : end + 1 + length].split(b"\n")
            version, names = int(about[0].split()[0]), about[1].decode().split()
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
        else:
            parts = line.rsplit(" ", len(names) - 1)
            if len(parts) != len(names):
                raise ValueError(f"ARC header line at byte {at} has {len(parts)} of {len(names)} fields")
            head = dict(zip(names, parts, strict=True))
            length = int(head["Archive-length"])
            if end + 1 + length > len(data):
                raise ValueError(f"ARC record at byte {at} declares more bytes than follow")
            yield ArcRecord(head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"], data[end + 1 : end + 1 + length], version)
        at = end + 1 + length


def iso_date(date: str) -> str:
    """14 digits, or the 8 to 12 of older archives, as a WARC date."""
    d = (date + "00000101000000"[len(date) :])[:14] if len(date) >= 4 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: int | None, url: str) -> str:
    """A UUID of version 8 that holds the 64-bit key, a bit that tells a null key, and 48 bits of the url's digest."""
    value = 0 if key is None else key & ((1 << 64) - 1)
    a = int.from_bytes(hashlib.sha1(url.encode("utf-8", "surrogateescape")).digest()[:6], "big")
    b = (value >> 62) | (4 if key is None else 0)
    return f"urn:uuid:{uuid.UUID(int=a << 80 | 8 << 76 | b << 64 | 2 << 62 | (value & ((1 << 62) - 1)))}"


def key_of(identifier: str) -> int | None:
    n = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    b = n >> 64 & 0xFFF
    value = (b & 3) << 62 | n & ((1 << 62) - 1)
    return None if b & 4 else value - (1 << 64) if value >> 63 else value


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and the payload. Content that isn't HTTP is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?mi)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode() if found else None


def to_warc(record: ArcRecord, key: int | None, original: int | None) -> bytes:
    """The WARC record of an ARC record. original: the key of the response with the same payload, if that is another."""
    head, payload = split_http(record.content)
    kind = "revisit" if original is not None and original != key else "response" if head else "resource"
    block = head if kind == "revisit" else record.content
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(key, record.url)}>", f"WARC-Date: {iso_date(record.date)}",
        f"WARC-Target-URI: {record.url}", f"WARC-IP-Address: {record.ip}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(original, '')}>", f"X-Payload-Bytes: {len(payload)}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else record.mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own whose last byte is 0: the high byte of its length, or that of an empty member after it."""
    data = gzip.compress(record, 1, mtime=0)
    return data if data[-1] == 0 else data + gzip.compress(b"", 1, mtime=0)


def unzipped(data: bytes) -> bytes:
    """The content of all gzip members of an archive, or the archive itself if it is plain.

    gzip.decompress() copies what is left of the data for every member; members of an archive are as many as its records.
    """
    if data[:2] != b"\x1f\x8b":
        return data
    view, at, parts = memoryview(data), 0, []
    while at < len(view):
        if not view[at]:  # zeros may stand after a member
            at += 1
            continue
        one, step = zlib.decompressobj(31), WINDOW
        while not one.eof:
            if at == len(view):
                raise EOFError("the archive ends within a gzip member")
            piece = view[at : at + step]
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
            step = min(2 * step, 1 << 20)
    return b"".join(parts)


def warcinfo() -> bytes:
    block = b"software: sylva\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id(None, 'warcinfo')}>", f"WARC-Date: {iso_date(CAPTURED)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared lengths; block digests are verified."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if fields.get("warc-block-digest", "").removeprefix("sha1:") not in ("", base32_sha1(block)):
            raise ValueError(f"the block at byte {end + 4} doesn't match its digest")
        yield fields, block
        at = end + 4 + size + 4


def legacy_content(key: int | None, payload: bytes) -> bytes:
    own = b"" if key is None else b"X-Page-ID: %d\r\n" % key
    return b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def legacy_archives(rows: Iterable[tuple[int | None, str | None, bytes]], name: str) -> Iterator[bytes]:
    """ARC archives of about ARCHIVE_BYTES with a record for each (id, url, payload); versions take turns."""
    held, size, n = [], 0, 0
    for key, url, payload in rows:
        held.append((re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none", legacy_content(key, payload)))
        size += len(payload)
        if size >= ARCHIVE_BYTES:
            yield write_arc(f"{name}-{n}.arc", 1 + n % 2, held)
            held, size, n = [], 0, n + 1
    if held:
        yield write_arc(f"{name}-{n}.arc", 1 + n % 2, held)


RECORD = "key long, url string, ip string, date string, mime string, version int, content binary, sha string, size long"


def write_legacy(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(name, content): legacy archives, of both versions, with a record for each row of pages."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for k, archive in enumerate(legacy_archives(rows, f"legacy-{task}-{n}")):
                yield pa.RecordBatch.from_arrays([pa.array([f"legacy-{task}-{n}-{k}.arc"]), pa.array([archive], pa.binary())], names=["name", "content"])

    body: Column = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    return pages.select(F.col(key).cast("long"), F.col(url), body).mapInArrow(make, "name string, content binary")


def read_legacy(archives: DataFrame, bodies: bool = True) -> DataFrame:
    """The records of archives (content), plain or gzipped, with the digest and size of each payload; content is null without bodies."""
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                rows = []
                for r in parse_arc(unzipped(data)):
                    head, payload = split_http(r.content)
                    own = http_field(head, b"X-Page-ID")
                    rows.append((None if own is None else int(own), r.url, r.ip, r.date, r.mime, r.version, r.content if bodies else None, base32_sha1(payload), len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return archives.select("content").mapInArrow(read, RECORD)


def originals(records: DataFrame, min_bytes: int) -> DataFrame:
    """(_sha, original) of each payload of at least min_bytes that several records have. Counted before the shuffle, so a payload of many records is no hot key."""
    named = records.filter(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("key").alias("original"), F.count("*").alias("n"))
    return named.filter("n > 1").select(F.col("sha").alias("_sha"), "original")


def convert(archives: DataFrame, path: str, settle, min_bytes: int = 0) -> None:
    """Write the records of legacy archives (content) as WARC files below path: the largest key of equal payloads is the response, others revisit it."""
    records = read_legacy(archives)
    first = settle(originals(read_legacy(archives, False).select("key", "sha", "size"), min_bytes), "payloads")
    few = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = records.join(F.broadcast(first) if few else first, records["sha"] == first["_sha"], "left").select("key", "url", "ip", "date", "mime", "version", "content", "original")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [member(warcinfo())], 0
        for batch in batches:
            for key, url, ip, date, mime, version, content, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(member(to_warc(ArcRecord(url, ip, date, mime, content, version), key, original)))
                size += len(held[-1])
                if size >= CHUNK_BYTES:
                    yield chunk(held)
                    held, size = [member(warcinfo())], 0
        if size:
            yield chunk(held)

    def chunk(members: list[bytes]) -> pa.RecordBatch:
        # The text writer ends each row with its separator: a 0, the last byte of a member.
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], names=["members"])

    out = joined.mapInArrow(make, "members binary").select(F.col("members").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_CHUNKS).text(path)


def write_warc(pages: DataFrame, path: str, settle, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Write the rows of pages, by way of legacy archives, as WARC files below path."""
    convert(settle(write_legacy(pages, key, url, payload), "archives"), path, settle, min_bytes)


def read_warc(files: DataFrame) -> DataFrame:
    """(key, url, date, payload_bytes, payload_digest, record_type, refers_to) of every record of binaryFile rows.

    Sizes and digests are those of the full payload: a revisit declares them in its own headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                rows = []
                for fields, block in parse_warc(unzipped(data)):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    kind, digest, own = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), http_field(head, b"X-Page-ID")
                    if kind != "revisit" and digest != base32_sha1(payload):
                        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't match its digest")
                    size = int(fields.get("x-payload-bytes") or http_field(head, b"Content-Length") or 0) if kind == "revisit" else len(payload)
                    rows.append((None if own is None else int(own), fields["warc-target-uri"], fields["warc-date"], size, digest, kind, key_of(fields["warc-refers-to"]) if kind == "revisit" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    return files.select("content").mapInArrow(read, "key long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long")
