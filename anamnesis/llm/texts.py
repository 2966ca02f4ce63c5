"""Columns and flat arrays of whole texts, shared by the corpus operators.

Texts reach Python as Arrow batches of UTF-8 bytes. A batch is cut into slices of bounded size, so
the memory of a task does not follow the length of a partition; one very long text is a slice alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SLICE_BYTES = 4 * 1024 * 1024


def utf8(column: str) -> Column:
    """The text as bytes; a NULL text is the empty one."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``doc_id, data`` and what else is asked for; other columns of the input are not carried."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("data"), *more)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column, and the ``n + 1`` offsets of its rows."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "data", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``limit`` bytes in ``column``, one row at least."""
    _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i], starts[i] + 1, ...`` of all rows one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def tables_of(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"
