"""Derived tables that are used more than once, and joins against sides of a checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoints, scratch_path

BROADCAST_BYTES = 64 * 1024 * 1024


def settle(df: DataFrame) -> DataFrame:
    """Write a small derived table (class sizes, rates, models) once to the shared checkpoint folder.

    Later uses read it back instead of repeating the aggregation over the facts, and a lost
    executor cannot make it change.
    """
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table that several passes need to a Parquet folder under the shared one, and read it from there.

    For design rows and other joins of the facts: one write saves the later passes the shuffles,
    and they read only the columns they use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(settled: DataFrame, cell_bytes: int = 64, array_column: str | None = None, text_columns: Sequence[str] = ()) -> DataFrame:
    """Mark a settled table for broadcast where its counted size is under BROADCAST_BYTES.

    The size is rows (or the summed lengths of ``array_column``) times ``cell_bytes``, and the measured bytes of the
    ``text_columns``. Beyond it the table is returned unmarked and Spark joins it by shuffle, splitting hot keys.
    """
    cells = F.count(F.lit(1)) if array_column is None else F.sum(F.size(array_column))
    size = cells * cell_bytes
    for c in text_columns:
        size = size + F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    total = settled.agg(size.alias("c")).first()["c"] or 0
    return F.broadcast(settled) if total <= BROADCAST_BYTES else settled
