"""WARC records in ZIP packages: a writer, and a reader that finds and range-reads records without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member for each record) and ``indexes/index.cdxj`` (a line
for each record with its offset and length), both as stored members. The reader parses the end records and the
central directory, ZIP64 ones too, and then reads only the byte ranges it needs through ``read_at(offset,
length)``, so a package may lie in any store.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import quoted, slices

#: Bytes of compressed records after which a task begins its next package.
PACKAGE_BYTES = 3 << 20
#: Payloads shorter than this are never deduplicated; tasks among which rows of one payload are dealt.
LEAST_DEDUPLICATED, SALT = 100, 16
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Signatures of the ZIP structures, the ZIP64 extra field, the revisit profile and the date.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
EXTRA64, FULL32, FULL16 = 1, 0xFFFFFFFF, 0xFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class Corrupt(ValueError):
    """A package or record that breaks its format or fails a checksum."""


# -- ZIP ---------------------------------------------------------------------------------------------


def zip_package(members: list[tuple[str, bytes]], zip64: bool | None = None) -> bytes:
    """A ZIP file of stored members. ZIP64 structures are written where sizes need them, or always if asked."""
    out, entries, at = [], [], 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or (zip64 is None and max(n, at) >= FULL32)
        extra = struct.pack("<HHQQ", EXTRA64, 16, n, n) if wide else b""
        head = struct.pack("<4sHHHHHIIIHH", LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, FULL32 if wide else n, FULL32 if wide else n, len(raw), len(extra))
        out += [head, raw, extra, data]
        extra = struct.pack("<HHQQQ", EXTRA64, 24, n, n, at) if wide else b""
        entries.append(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, FULL32 if wide else n, FULL32 if wide else n, len(raw), len(extra), 0, 0, 0, 0, FULL32 if wide else at) + raw + extra)
        at += len(head) + len(raw) + len(extra[:20]) + n
    directory = b"".join(entries)
    wide = zip64 or (zip64 is None and (at >= FULL32 or len(entries) >= FULL16))
    out.append(directory)
    if wide:
        out.append(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, len(entries), len(entries), len(directory), at))
        out.append(struct.pack("<4sIQI", LOCATOR64, 0, at + len(directory), 1))
    out.append(struct.pack("<4sHHHHIIH", END, 0, 0, *(FULL16 if wide else len(entries),) * 2, FULL32 if wide else len(directory), FULL32 if wide else at, 0))
    return b"".join(out)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    size: int
    header: int


class ZipReader:
    """The directory of a ZIP file of ``size`` bytes, read through ``read_at(offset, length)``."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size = read_at, size
        tail_at = max(0, size - 22 - FULL16)
        tail = read_at(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)  # the mark inside a comment
        if at < 0:
            raise Corrupt("no end of a central directory")
        _, _, _, _, count, length, start, _ = struct.unpack_from("<4sHHHHIIH", tail, at)
        where = tail_at + at - 20
        locator = read_at(where, 20) if where >= 0 else b""
        if locator[:4] == LOCATOR64:
            end64 = struct.unpack("<4sIQI", locator)[2]
            record = read_at(end64, 56)
            if record[:4] != END64:
                raise Corrupt("the ZIP64 locator leads nowhere")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, Member] = {}
        directory, at = read_at(start, length), 0
        for _ in range(count):
            if directory[at : at + 4] != CENTRAL:
                raise Corrupt("the central directory is broken")
            _, _, _, _, method, _, _, crc, packed, whole, n, m, k, _, _, _, header = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, at)
            name = directory[at + 46 : at + 46 + n].decode()
            extra, p = directory[at + 46 + n : at + 46 + n + m], 0
            while p + 4 <= len(extra):
                kind, width = struct.unpack_from("<HH", extra, p)
                if kind == EXTRA64:
                    q = p + 4
                    if whole == FULL32:
                        (whole,), q = struct.unpack_from("<Q", extra, q), q + 8
                    if packed == FULL32:
                        (packed,), q = struct.unpack_from("<Q", extra, q), q + 8
                    if header == FULL32:
                        (header,) = struct.unpack_from("<Q", extra, q)
                p += 4 + width
            self.members[name] = Member(name, method, crc, packed, header)
            at += 46 + n + m + k

    def begin(self, name: str) -> int:
        """Where a stored member's bytes begin in the file."""
        if name not in self.members:
            raise Corrupt(f"no member {name}")
        member = self.members[name]
        if member.method != 0:
            raise Corrupt(f"{name} is compressed by the package; only stored members can be range-read")
        head = self.read_at(member.header, 30)
        if head[:4] != LOCAL:
            raise Corrupt(f"no local header of {name}")
        n, m = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n + m

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member; a whole member's CRC is verified."""
        member = self.members.get(name)
        at = self.begin(name)
        if offset < 0 or offset + (length or 0) > member.size:
            raise Corrupt("a range outside the member")
        data = self.read_at(at + offset, member.size - offset if length is None else length)
        if offset == 0 and length is None and zlib.crc32(data) != member.crc:
            raise Corrupt(f"the CRC of {name} differs")
        return data


# -- WARC --------------------------------------------------------------------------------------------


def urn(page: int | None) -> str:
    return f"<urn:x-keelstone:page:{'null' if page is None else page}>"


def from_urn(text: str) -> int | None:
    tail = text.rstrip(">").rsplit(":", 1)[1]
    return None if tail == "null" else int(tail)


def record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the response's HTTP head (with its full length) but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Page, type, payload (None for a revisit), its length and digest of one uncompressed record."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not cut or lines[0] != "WARC/1.1":
        raise Corrupt("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise Corrupt("a record's length differs")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise Corrupt("a payload's digest differs")
    refers = from_urn(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": from_urn(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "type": kind, "payload": payload if kind == "response" else None, "payload_bytes": length, "digest": digest, "refers_to": refers}


class Packer:
    """Gathers records into one package."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.lines: list[str] = []
        self.size = 0

    def add(self, page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> None:
        raw = record(page, url, payload, digest, refers_to, revisit)
        squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
        packed = squeeze.compress(raw) + squeeze.flush()
        self.lines.append(json.dumps({"page_id": page, "digest": digest, "offset": self.size, "length": len(packed)}))
        self.parts.append(packed)
        self.size += len(packed)

    def finish(self, zip64: bool | None = None) -> bytes:
        return zip_package([(DATA, b"".join(self.parts)), (INDEX, "\n".join(self.lines).encode())], zip64)


def records(read_at: Callable[[int, int], bytes], size: int) -> Iterator[dict]:
    """Every record of a package, each by its own range read at the place its index names."""
    package = ZipReader(read_at, size)
    for line in package.read(INDEX).splitlines():
        at = json.loads(line)
        yield parse(zlib.decompress(package.read(DATA, at["offset"], at["length"]), 31))


# -- Spark -------------------------------------------------------------------------------------------


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", zip64: bool | None = None) -> DataFrame:
    """Write each page as a WARC record; returns the stored table ``package string, data binary`` of packages.

    Of equal payloads of at least 100 bytes, rows with the smallest id are responses and the others revisit
    them; shorter ones are responses. Null payloads count as empty, null urls too; a null id is never what
    others refer to unless no equal payload has an id; other columns are ignored. Digests that occur once are
    dropped before the join, which is a broadcast only if the planner finds the rest small; else rows of one
    digest are dealt by SALT salts, and short payloads, which match nothing, by their ids.
    """
    slim = pages.select(F.col(quoted(id_col)).cast("bigint").alias("page_id"), F.coalesce(F.col(quoted(url_col)).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(quoted(html_col)).cast("string"), F.lit("")).alias("html"))
    slim = slim.withColumn("digest", F.sha2("html", 256))
    many = slim.filter(F.octet_length("html") >= LEAST_DEDUPLICATED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    first = stored(many.select("digest", "first"), "first-pages")
    salted = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")).select(F.concat_ws(":", "digest", "salt").alias("d"), "first")
    salt = F.when(F.octet_length("html") >= LEAST_DEDUPLICATED, F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("string")).otherwise(F.concat_ws("-", F.lit("short"), "page_id", "url"))
    marked = slim.join(salted, F.concat_ws(":", "digest", salt) == F.col("d"), "left").select("page_id", "url", "html", "digest", "first", (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, packer = TaskContext.get().partitionId(), 0, Packer()

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:07d}-{made:05d}.wacz"]), pa.array([packer.finish(zip64)], pa.binary())], names=["package", "data"])

        for part in slices(batches, "html"):
            for page, url, html, digest, refers, revisit in zip(*(c.to_pylist() for c in part.columns), strict=True):
                packer.add(page, url, html.encode("utf-8", "replace"), digest, refers if revisit else None, revisit)
                if packer.size >= PACKAGE_BYTES:
                    yield finished()
                    made, packer = made + 1, Packer()
        if packer.parts:
            yield finished()

    return stored(marked.mapInArrow(run, "package string, data binary"), "packages")


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of a table of packages: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to`` (and ``payload``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = memoryview(batch.column("data")[i].as_buffer())
                rows = list(records(lambda at, n, data=data: bytes(data[at : at + n]), len(data)))
                columns = [[r[k] for r in rows] for k in ("page_id", "url", "type", "payload_bytes", "digest", "refers_to")]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
                if with_payload:
                    arrays.append(pa.array([r["payload"] for r in rows], pa.binary()))
                    names.append("payload")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + (", payload binary" if with_payload else "")
    return packages.select("data").mapInArrow(run, schema)
