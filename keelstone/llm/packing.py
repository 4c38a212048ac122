"""Packing of documents into sequences of fixed length by the sum-of-squares rule.

With N(g) open sequences that have a gap of g tokens, a piece goes to the gap for which the sum of N(g)^2
becomes smallest: this keeps the gaps varied, so later pieces find one that fits exactly. Pieces are placed
longest first, and a new sequence is opened only when no gap is large enough (opening more often leaves more
sequences at the end; see README).
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .bpe import encoder, words_pattern
from .common import id_text, slices, texts

#: Pieces that one task packs; each shard of this size leaves a few sequences part full.
SHARD = 40_000

_LOADED: dict[str, object] = {}


def rank_encoder(ranks: str, special: dict[str, int]):
    """The vocabulary as ranks for a worker process; ``special`` strings inside texts become their ids."""
    import tiktoken

    key = f"{ranks} {special}"
    if key not in _LOADED:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[key] = tiktoken.Encoding("ranks", pat_str=words_pattern(), mergeable_ranks=table, special_tokens=special)
    return _LOADED[key]


def token_ids(text: str, tokenizer: str, ranks: str) -> list[int]:
    """Ids of a text as the tokenizer's file gives them, special strings included.

    The rank table's encoder is the quick way; where its pattern engine gives up (on a million blanks in a
    row, say) the trie encoder takes over: both give the same ids.
    """
    exact = encoder(tokenizer)
    try:
        return rank_encoder(ranks, exact.special).encode(text, allowed_special="all")
    except ValueError:
        return exact.encode([text])[0]


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, pieces taken in the order given."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[size:])
        if len(gaps):
            # N(g)^2 + N(g-size)^2 -> (N(g)-1)^2 + (N(g-size)+1)^2; a filled sequence is no longer counted
            change = 2 * (count[gaps] - count[size + gaps]) + 2
            if gaps[0] == 0:
                change[0] = 1 - 2 * count[size]
            gap = size + int(gaps[change.argmin()])
            number = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, number = capacity, made
            made += 1
        sequence[i], offset[i] = number, capacity - gap
        if gap > size:
            open_by_gap[gap - size].append(number)
            count[gap - size] += 1
    return sequence, offset


def pieces(df: DataFrame, tokenizer: str, ranks: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of each document's pieces; no shuffle.

    A document is its ids and ``end_id``; only a longer one than ``capacity`` is cut, and all its pieces
    but the first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(part.column("doc_id").to_pylist(), texts(part), strict=True):
                ids = np.array([*token_ids(text, tokenizer, ranks), end_id], "<u4")
                head = len(ids) % capacity or capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row = (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = slice(None) if with_ids else slice(5)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out[keep], kinds[keep], strict=True)], names=names[keep])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return id_text(df, id_col, text_col).mapInArrow(run, schema)


def pack(found: DataFrame, capacity: int = 1024, shard: int = SHARD) -> DataFrame:
    """Add ``sequence_id, offset`` to a table of pieces (``length`` from 1 to ``capacity``).

    Full pieces are sequences of their own and never move. The rest is dealt at random into shards of about
    ``shard`` pieces, so no task's load depends on a source or document, and each shard is packed alone; no
    sequence crosses shards. ``found`` should be a stored table: it is read three times.
    """
    partial = found.filter(F.col("length") < capacity)
    n = partial.count()
    shards = max(1, -(-n // shard))
    order = [c for c in found.columns if c != "length"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *[c for c in ("doc_id", "piece", "ids_crc32") if c in order]], ascending=False, kind="stable").reset_index(drop=True)
        sequence, offset = place(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = sequence + rows["_shard"].astype("int64") * (1 << 40)
        rows["offset"] = offset
        return rows.drop(columns="_shard")

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    spread = F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece", "ids_crc32", "length") if c in found.columns], F.monotonically_increasing_id()), F.lit(shards))
    packed = partial.withColumn("_shard", spread).groupBy("_shard").applyInPandas(one, f"{columns}, sequence_id bigint, offset bigint")
    full = found.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.unionByName(full)


def pack_documents(df: DataFrame, tokenizer: str, ranks: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``tokenizer`` and ``ranks`` are paths of one vocabulary in its two forms, readable on every executor.
    A null text counts as empty (one piece: ``end_id``); a repeated row is packed as often as it occurs; a
    null id is kept; other columns are ignored; an empty table gives no rows.
    """
    made = pieces(df, tokenizer, ranks, capacity, end_id, id_col, text_col)
    made = made.withColumn("_null", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    out = pack(stored(made, "pieces"), capacity)
    return out.select(F.when(~F.col("_null"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
