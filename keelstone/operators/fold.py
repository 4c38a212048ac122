"""The exact sequential fold of one key's commands, for batches and streams.

Keys are dealt by hash and each partition is sorted by key and order, so a task walks its rows once and holds
one key's state: a hot key costs time in one task (its order allows nothing else) but never memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NEVER

LOW, HIGH = -(2**63), 2**63 - 1
NOT_INTEGER = "ERR value is not an integer or out of range"
OVERFLOW = "ERR increment or decrement would overflow"

#: One command on one key. ``n``: the absolute expiry of SET (null: none) and EXPIRE, the step of INCR.
OPS = "key string, seq bigint, pos int, ts_ms bigint, op string, value string, n bigint"
#: What it answers (number, text or error), and the entry it leaves if it changed something (value null: deleted).
RESULTS = "key string, seq bigint, pos int, ts_ms bigint, op string, num bigint, text string, err string, changed boolean, value string, expires_at_ms bigint"

State = tuple[str, int] | None  # value and expiry, or absent


def long_of(text: str | None) -> int | None:
    """A 64-bit integer of an optional sign and ASCII digits."""
    if not text:
        return None
    digits = text[1:] if text[0] in "+-" else text
    if not digits or not digits.isascii() or not digits.isdigit():
        return None
    n = int(text)
    return n if LOW <= n <= HIGH else None


def listed(column: pa.Array) -> list:
    """The values of a column, as its to_pylist gives them; texts, numbers and truth values go through numpy, which is faster."""
    if column.null_count == len(column):
        return [None] * len(column)
    kind = column.type
    if pa.types.is_string(kind) or (column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_boolean(kind))):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(kind):  # numpy has no integers with nulls
        known = column.is_valid().to_numpy(zero_copy_only=False).tolist()
        return [n if ok else None for n, ok in zip(column.fill_null(0).to_numpy().tolist(), known, strict=True)]
    return column.to_pylist()


def step(state: State, op: str, now: int, value: str | None, n: int | None) -> tuple[State, bool, int | None, str | None, str | None]:
    """The next state, whether it is a write, and the answer as number, text or error."""
    alive = state is not None and now < state[1]
    if op == "SET":
        return (value, NEVER if n is None else n), True, None, "OK", None
    if op == "DEL":
        return (None, True, 1, None, None) if alive else (state, False, 0, None, None)
    if op == "ERASE":  # the library's delete: a tombstone is written whatever was there
        return None, True, None, None, None
    if op == "INCR":
        if not alive:
            return (str(n), NEVER), True, n, None, None
        old = long_of(state[0])
        if old is None:
            return state, False, None, None, NOT_INTEGER
        if not LOW <= old + n <= HIGH:
            return state, False, None, None, OVERFLOW
        return (str(old + n), state[1]), True, old + n, None, None
    if op == "EXPIRE":
        return ((state[0], n), True, 1, None, None) if alive else (state, False, 0, None, None)
    if op == "PERSIST":
        if alive and state[1] != NEVER:
            return (state[0], NEVER), True, 1, None, None
        return state, False, 0, None, None
    if op == "GET":
        return state, False, int(alive), state[0] if alive else None, None
    if op == "TTL":
        return state, False, -2 if not alive else -1 if state[1] == NEVER else state[1] - now, None, None
    if op == "REFUSED":  # answered before it came to a key
        return state, False, None, None, value
    raise ValueError(f"no operation {op!r}")


def fold(ops: DataFrame, before: DataFrame | None = None, along: tuple[str, ...] = ()) -> DataFrame:
    """Results of every row of ``ops`` in the order of ``(seq, pos)`` for each key.

    ``before``: entries ``key, value, expires_at_ms`` that the keys start from. ``along``: text columns that rows keep.
    """
    columns = [*(c.split()[0] for c in OPS.split(", ")), *along]
    rows = ops.select(*columns)
    if before is not None:
        rows = rows.unionByName(before.select("key", F.lit(LOW).alias("seq"), F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("ts_ms"), F.lit("LOAD").alias("op"), "value", F.col("expires_at_ms").alias("n"), *[F.lit(None).cast("string").alias(c) for c in along]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = [*(c.split()[0] for c in RESULTS.split(", ")), *along]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), *[pa.string()] * len(along)]
        for batch in batches:
            out: list[tuple] = []
            for k, seq, pos, now, op, value, n, *rest in zip(*map(listed, batch.columns), strict=True):
                if k != key:
                    key, state = k, None
                if op == "LOAD":
                    state = (value, n)
                    continue
                state, changed, num, text, err = step(state, op, now, value, n)
                left = state if changed and state is not None else (None, None)
                out.append((k, seq, pos, now, op, num, text, err, changed, *left, *rest))
            data = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, kinds, strict=True)], names=names)

    dealt = rows.repartition("key").sortWithinPartitions("key", "seq", "pos")
    return dealt.mapInArrow(run, RESULTS + "".join(f", {c} string" for c in along))


def mutations_of(results: DataFrame) -> DataFrame:
    """The log rows that folded commands write; ``seq`` and ``pos`` together keep their order."""
    wrote = results.filter("changed")
    return wrote.select("seq", "pos", "ts_ms", F.when(F.col("value").isNull(), "DEL").otherwise("PUT").alias("op"), "key", "value", F.coalesce("expires_at_ms", F.lit(NEVER)).alias("expires_at_ms"))
