"""Structured Streaming: ingest of mutations, delivery of messages, and the per-key fold as a stateful operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import fold, pubsub
from ..schema import NEVER


def ingest(mutations: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of mutations to the log; each batch is one atomic commit, replays write nothing twice."""
    writer = mutations.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def deliver(messages: DataFrame, subscriptions: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Route each batch of messages with the subscriptions of that moment and hand the frames to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(pubsub.frames(rows, subscriptions()), number)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def folded(ops: DataFrame, late: str | None = None) -> DataFrame:
    """The exact fold over a stream of per-key operations; the state of a key is its entry, none if it has been deleted.

    Within a batch a key's rows go in order of ``(seq, pos)``; batches must come in that order for each key. With
    ``late`` (as '10 minutes') expired entries leave the state once the clocks of the stream, less that delay, have
    passed their expiry; rows that come later than the delay are dropped then, as they might have read them.
    """

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entry = tuple(state.get) if state.exists else None
        entry = None if entry is None else (entry[0], int(entry[1]))
        batch = pd.concat(list(rows)).sort_values(["seq", "pos"])
        out = []
        for r in batch.itertuples(index=False):
            n = None if pd.isna(r.n) else int(r.n)
            entry, changed, num, text, err = fold.step(entry, r.op, int(r.ts_ms), r.value, n)
            left = entry if changed and entry is not None else (None, None)
            out.append((key[0], r.seq, r.pos, r.ts_ms, r.op, num, text, err, changed, *left))
        if entry is not None and (late is None or entry[1] > state.getCurrentWatermarkMs()):
            state.update(entry)
            if late is not None and entry[1] < NEVER:
                state.setTimeoutTimestamp(entry[1])
        elif state.exists:
            state.remove()
        columns = dict(zip((c.split()[0] for c in fold.RESULTS.split(", ")), map(list, zip(*out, strict=True)), strict=True))
        # 64-bit numbers with nulls: never by way of floats
        yield pd.DataFrame({c: pd.array(v, "Int64") if c in ("num", "expires_at_ms") else v for c, v in columns.items()})

    columns = [c.split()[0] for c in fold.OPS.split(", ")]
    # a bigint with nulls would lose digits as a float on its way to Python; no expiry is sent as the largest
    sent = ops.select(*columns).withColumn("n", F.when(F.col("n").isNull() & (F.col("op") == "SET"), F.lit(NEVER)).otherwise(F.coalesce("n", F.lit(0))))
    timeout = GroupStateTimeout.NoTimeout
    if late is not None:
        sent, timeout = sent.withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", late), GroupStateTimeout.EventTimeTimeout
    return sent.groupBy("key").applyInPandasWithState(run, fold.RESULTS, "value string, expires_at_ms bigint", "append", timeout)
