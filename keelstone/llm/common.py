"""What the operators of this subpackage share: column selection and bounded batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  (not in every C library)
except (OSError, AttributeError):
    _LIBC = None

#: Bytes of text that one step of a Python worker holds as Python objects.
SLICE_BYTES = 4 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column, found as Spark does in any case if not as written."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id bigint, text string)`` of any table: extra columns go, a null text is the empty text."""
    return df.select(
        F.col(quoted(id_col)).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"),
    )


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        release()


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return batch.column(column).to_pylist()


def with_text(df: DataFrame, text_col: str, change: Callable[[pa.RecordBatch, list[str | None]], pa.RecordBatch], extra: str = "") -> DataFrame:
    """All columns of ``df`` through ``change(rows, their texts)``, some megabytes of text at a time; no shuffle.

    ``change`` may drop rows, replace columns, and append the columns that the DDL ``extra`` names.
    """
    schema = df.schema
    for field in StructType.fromDDL(extra).fields if extra else ():
        schema = StructType([*schema.fields, field])
    at = place_of(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # places instead of names, as names may repeat
            plain = pa.RecordBatch.from_arrays(batch.columns, names=[str(i) for i in range(batch.num_columns)])
            for part in slices([plain], str(at)):
                yield change(part, part.column(at).to_pylist())

    return df.mapInArrow(run, schema)
