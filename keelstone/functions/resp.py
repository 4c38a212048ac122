"""The text wire protocol: replies as column expressions, and a decoder of byte streams into commands."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: The largest numbers of arguments and bytes that a request may announce.
MAX_ARGS, MAX_BULK = 1_048_576, 512 * 1024 * 1024


def simple(text: Column) -> Column:
    return F.concat(F.lit("+"), text, F.lit(CRLF))


def error(text: Column) -> Column:
    return F.concat(F.lit("-"), text, F.lit(CRLF))


def integer(number: Column) -> Column:
    return F.concat(F.lit(":"), number.cast("string"), F.lit(CRLF))


def bulk(text: Column) -> Column:
    """A bulk string with its length in UTF-8 bytes; the null bulk for null."""
    return F.when(text.isNull(), F.lit("$-1" + CRLF)).otherwise(F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit(CRLF), text, F.lit(CRLF)))


def array(items: Column) -> Column:
    """An array of bulk strings; items may be null."""
    return F.concat(F.lit("*"), F.size(items).cast("string"), F.lit(CRLF), F.array_join(F.transform(items, bulk), ""))


def reply(kind: Column, text: Column, number: Column, items: Column) -> Column:
    """The bytes of a reply row by its type: + - : $ or *; null for no reply."""
    return F.when(kind == "+", simple(text)).when(kind == "-", error(text)).when(kind == ":", integer(number)).when(kind == "$", bulk(text)).when(kind == "*", array(items)).when(kind == "raw", text)


class ProtocolError(ValueError):
    """Bytes that are no request. ``kind`` says why: ``incomplete`` (more bytes might make one), ``number``, ``range``, ``mark`` or ``end``."""

    def __init__(self, kind: str, at: int):
        super().__init__(f"{kind} at byte {at}")
        self.kind, self.at = kind, at


#: The protocol's tokens: a count with its mark, the end of a counted body, a line of plain words.
_COUNT = re.compile(rb"([*$])([+-]?[0-9]{1,20})\r\n")
_PLAIN = re.compile(rb"(.[^\r\n]*)(\r\n|\n)", re.DOTALL)
_PART_OF_COUNT = re.compile(rb"[*$](?:[^\r]*|[+-]?[0-9]{1,20}\r)")
_PART_OF_PLAIN = re.compile(rb".[^\r\n]*\r?", re.DOTALL)
_BLANKS = bytes(range(33))


def _count(data: bytes, at: int, mark: bytes, least: int, most: int) -> tuple[int, int]:
    """The count that stands at ``at``, and the place after it."""
    if data[at : at + 1] not in (mark, b""):
        raise ProtocolError("mark", at)
    token = _COUNT.match(data, at)
    if token is None:
        raise ProtocolError("incomplete" if at == len(data) or _PART_OF_COUNT.fullmatch(data, at) else "number", at)
    value = int(token[2])
    if not least <= value <= most:
        raise ProtocolError("range", at)
    return value, token.end()


def parse_command(data: bytes, at: int) -> tuple[list[str | None] | None, int]:
    """The request at ``at`` and where the next one begins; None at the end of the bytes.

    A request is an array of counted bodies (a count of -1 is a null argument), or a line of words between blanks.
    """
    if at == len(data):
        return None, at
    if not data.startswith(b"*", at):
        line = _PLAIN.match(data, at)
        if line is None:
            raise ProtocolError("incomplete" if _PART_OF_PLAIN.fullmatch(data, at) else "end", at)
        first, *more = line[1].strip(_BLANKS).decode("latin-1").split(" ")
        return [first, *filter(None, more)], line.end()
    left, at = _count(data, at, b"*", 0, MAX_ARGS)
    arguments: list[str | None] = []
    for _ in range(left):
        size, at = _count(data, at, b"$", -1, MAX_BULK)
        if size < 0:
            arguments.append(None)
            continue
        stop = at + size
        if data[stop : stop + 2] != b"\r\n":
            raise ProtocolError("incomplete" if len(data) < stop + 2 and data[stop:] in (b"", b"\r") else "end", at)
        arguments.append(data[at:stop].decode("utf-8", "replace"))
        at = stop + 2
    return arguments, at


def decode(streams: DataFrame) -> DataFrame:
    """``session_id, pos, argv, error`` of byte streams ``session_id, bytes``.

    One row for each request in order; what cannot be parsed ends its session with a row whose ``error`` is set.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for session, data in zip(batch["session_id"], batch["bytes"], strict=True):
                data, at, pos = bytes(data or b""), 0, 0
                while True:
                    try:
                        argv, at = parse_command(data, at)
                    except ProtocolError as e:
                        rows.append((session, pos, None, str(e)))
                        break
                    if argv is None:
                        break
                    rows.append((session, pos, argv, None))
                    pos += 1
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["session_id", "pos", "argv", "error"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["session_id", "pos", "argv", "error"])

    return streams.select("session_id", "bytes").mapInPandas(run, "session_id string, pos bigint, argv array<string>, error string")
