"""Sinks: record files, splits, reports, column documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import row_index


def write_gzip_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").option("compression", "gzip").csv(path)


def write_indexed_csv(df: DataFrame, order: str, path: str) -> None:
    """CSV with a leading ``Index`` column, 0-based in the order of a unique number."""
    indexed = row_index(df, order)
    indexed.select("Index", *df.columns).write.option("header", "true").csv(path)


def write_parts(df: DataFrame, parts: int, path: str) -> None:
    """A fixed number of even CSV parts."""
    df.repartition(parts).write.option("header", "true").csv(path)


def write_partitioned(df: DataFrame, keys: Sequence[str], path: str, mode: str = "append") -> None:
    """Parquet folders per key.

    The rebalance hint groups the rows of a key into few files; adaptive execution splits a key
    that holds a large share of the rows over several tasks.
    """
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_report(df: DataFrame, path: str, decimals: int, names: Mapping[str, str]) -> None:
    """Report table: numbers with fixed decimals, metric columns renamed."""
    kinds = dict(df.dtypes)
    columns = [
        (F.format_string(f"%.{decimals}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c)).alias(names.get(c, c)) for c in df.columns
    ]
    df.select(*columns).write.option("header", "true").csv(path)


def write_column_json(df: DataFrame, order: str, columns: Sequence[str], path: str, chunk: int = 100_000) -> None:
    """``{"column": {"row": value}}`` documents, one per line, each of at most ``chunk`` rows."""
    work = row_index(df, order, "_i").withColumn("_chunk", F.floor(F.col("_i") / chunk))
    maps = [F.map_from_entries(F.collect_list(F.struct(F.col("_i").cast("string"), F.col(c).cast("string")))).alias(c) for c in columns]
    docs = work.groupBy("_chunk").agg(*maps).select(F.to_json(F.struct(*columns)).alias("value"))
    docs.write.text(path)


def write_column_lists(df: DataFrame, order: str, columns: Sequence[str], path: str, chunk: int = 100_000) -> None:
    """``{"column": [values]}`` documents in row order, one per line, each of at most ``chunk`` rows."""
    work = row_index(df, order, "_i").withColumn("_chunk", F.floor(F.col("_i") / chunk))
    rows = work.groupBy("_chunk").agg(F.array_sort(F.collect_list(F.struct("_i", *columns))).alias("r"))
    lists = [F.col("r")[c].alias(c) for c in columns]
    rows.select(F.to_json(F.struct(*lists)).alias("value")).write.text(path)
