"""Raw write-ahead logs: framed records ``[length][payload][CRC-32]``, big-endian.

A put's payload is the byte 1, key, value and expiry (which old records lack); a delete's is the byte 0 and the
key. Texts are a 16-bit length and Java's modified UTF-8. A log is good up to its first broken frame.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DEL, NEVER, PUT

LIMIT = 65_535


def _text(s: str) -> bytes:
    wide = s.encode("utf-16-be", "surrogatepass")
    units = struct.unpack(f">{len(wide) // 2}H", wide)
    raw = b"".join(b"\xc0\x80" if u == 0 else chr(u).encode("utf-8", "surrogatepass") for u in units)
    if len(raw) > LIMIT:
        raise ValueError(f"a text of {len(raw)} bytes; a log record holds {LIMIT}")
    return struct.pack(">H", len(raw)) + raw


def _untext(data: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from(">H", data, at)
    raw = data[at + 2 : at + 2 + n]
    if len(raw) < n:
        raise ValueError("a text is cut off")
    units = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
    return units.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace"), at + 2 + n


def frame(op: str, key: str, value: str | None = None, expires_at_ms: int | None = NEVER) -> bytes:
    """One record; ``expires_at_ms`` None writes a put of the old form."""
    payload = b"\0" + _text(key) if op == DEL else b"\1" + _text(key) + _text(value or "") + (b"" if expires_at_ms is None else struct.pack(">q", expires_at_ms))
    return struct.pack(">i", len(payload)) + payload + struct.pack(">I", zlib.crc32(payload))


def replay(data: bytes) -> Iterator[tuple[int, str, str, str | None, int]]:
    """``(offset, op, key, value, expiry)`` of the valid prefix."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(">i", data, at)
        end = at + 4 + n
        if n < 1 or end + 4 > len(data):
            return
        payload = data[at + 4 : end]
        if zlib.crc32(payload) != struct.unpack_from(">I", data, end)[0]:
            return
        try:
            key, p = _untext(payload, 1)
            if payload[0] == 0:
                yield at, DEL, key, None, NEVER
            elif payload[0] == 1:
                value, p = _untext(payload, p)
                yield at, PUT, key, value, struct.unpack_from(">q", payload, p)[0] if len(payload) >= p + 8 else NEVER
            else:
                return
        except (ValueError, struct.error):
            return
        at = end + 4


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """``file, seq, ts_ms, op, key, value, expires_at_ms`` of raw logs, a task for each; ``seq`` is the record's number in its file.

    Several logs (a rotated one before the active one) order by ``file``; a missing path gives Spark's error, an
    empty file no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(file, i, 0, op, key, value, until) for i, (_, op, key, value, until) in enumerate(replay(bytes(data)))]
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "seq", "ts_ms", "op", "key", "value", "expires_at_ms"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, seq bigint, ts_ms bigint, op string, key string, value string, expires_at_ms bigint")


def valid_prefix(frames: DataFrame, file: str = "file", order: str = "offset", bad: str = "bad") -> DataFrame:
    """The rows of each log before its first bad one."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("_bad", F.max(F.col(bad).cast("int")).over(w)).filter("_bad = 0").drop("_bad")


def checked(frames: DataFrame) -> DataFrame:
    """Frames ``offset, payload, stored_crc`` with ``bad``: whether the checksum differs."""
    return frames.withColumn("bad", F.crc32("payload") != F.col("stored_crc"))
