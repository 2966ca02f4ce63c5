"""Dot products of all pairs of sparse rows, by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .sizes import settle

ROW_BLOCK = 256
COLUMN_BLOCK = 4096


def _block_product(key: tuple, pdf: pd.DataFrame, row_block: int) -> pd.DataFrame:
    left_block, right_block, _ = key
    rows = np.sort(pdf["_row"].unique())
    columns = np.sort(pdf["_col"].unique())
    dense = np.zeros((len(rows), len(columns)))
    dense[np.searchsorted(rows, pdf["_row"]), np.searchsorted(columns, pdf["_col"])] = pdf["_val"]
    left = np.flatnonzero(rows // row_block == left_block)
    right = np.flatnonzero(rows // row_block == right_block)
    product = dense[left] @ dense[right].T
    filled = (dense != 0).astype(float)
    common = filled[left] @ filled[right].T
    i, j = np.nonzero(common)
    a, b = rows[left[i]], rows[right[j]]
    keep = a < b
    return pd.DataFrame({"_a": a[keep], "_b": b[keep], "dot": product[i, j][keep], "common": common[i, j][keep].astype("int64")})


def dot_products(
    entries: DataFrame, row: str, column: str, value: str, row_block: int = ROW_BLOCK, column_block: int = COLUMN_BLOCK
) -> DataFrame:
    """(a, b, dot, common) for all a < b that share a column: dot product and number of shared columns.

    Rows are the classes (or codes) of a pre-aggregated table. They are cut into blocks of
    ``row_block``, and each pair of blocks is multiplied as a matrix inside one task, in slices of
    ``column_block`` columns: a task never holds more than 2 x row_block x column_block numbers,
    and the only pairs made are those of the result.
    """
    entries = settle(entries.select(row, column, F.col(value).cast("double").alias("_val")).where(F.col("_val") != 0))

    def numbered(name: str, out: str) -> DataFrame:
        return entries.select(name).distinct().withColumn(out, F.row_number().over(Window.orderBy(name)) - 1)

    rows, columns = numbered(row, "_row"), numbered(column, "_col")
    work = entries.join(rows, row).join(columns, column).select("_row", "_col", "_val")
    blocks = rows.agg(F.coalesce(F.floor(F.max("_row") / row_block), F.lit(0)).alias("b")).scalar()
    own = F.floor(F.col("_row") / row_block)
    spread = work.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks)))
    spread = spread.withColumn("_left", F.least(own, "_other")).withColumn("_right", F.greatest(own, "_other"))
    spread = spread.withColumn("_slice", F.floor(F.col("_col") / column_block))

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _block_product(key, pdf, row_block)

    parts = spread.groupBy("_left", "_right", "_slice").applyInPandas(multiply, "_a bigint, _b bigint, dot double, common bigint")
    sums = parts.groupBy("_a", "_b").agg(F.sum("dot").alias("dot"), F.sum("common").alias("common"))
    names_a = rows.select(F.col("_row").cast("bigint").alias("_a"), F.col(row).alias("a"))
    names_b = rows.select(F.col("_row").cast("bigint").alias("_b"), F.col(row).alias("b"))
    return sums.join(names_a, "_a").join(names_b, "_b").select("a", "b", "dot", "common")


def cross_products(left: DataFrame, right: DataFrame, row: str, column: str, value: str, row_block: int = ROW_BLOCK, column_block: int = COLUMN_BLOCK) -> DataFrame:
    """(a, b, dot) of all rows a of ``left`` and b of ``right`` that share a column.

    Rows and columns are dealt to blocks by a hash; a task multiplies two blocks in one slice of columns, as in
    ``dot_products``, and the only pairs made are those of the result. A row is told from others by its value, which is not NULL.
    """
    sides = [settle(df.select(F.col(row).alias("_row"), F.col(column).alias("_col"), F.col(value).cast("double").alias("_val")).where(F.col("_val") != 0)) for df in (left, right)]
    blocks = [side.agg(F.greatest(F.ceil(F.count_distinct("_row") / row_block), F.lit(1))).scalar() for side in sides]
    slices = sides[1].agg(F.greatest(F.ceil(F.count_distinct("_col") / column_block), F.lit(1))).scalar()
    kinds = [dict(side.dtypes)["_row"] for side in sides]

    def dealt(name: str, count: Column) -> Column:
        return F.pmod(F.xxhash64(name), count)

    spread = []
    for own, other in ((0, 1), (1, 0)):
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks[other] - 1))
        placed = sides[own].withColumn("_own", dealt("_row", blocks[own])).withColumn("_slice", dealt("_col", slices)).withColumn("_other", every)
        names = {"_own": "_left", "_other": "_right"} if own == 0 else {"_own": "_right", "_other": "_left"}
        spread.append(placed.withColumnsRenamed(names).withColumnRenamed("_row", f"_row{own}"))
    keys = ["_left", "_right", "_slice"]

    def multiply(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        columns = np.intersect1d(one["_col"].to_numpy(), two["_col"].to_numpy())
        dense, rows = [], []
        for side, pdf in enumerate((one, two)):
            pdf = pdf[pdf["_col"].isin(columns)]
            at, names = pd.factorize(pdf[f"_row{side}"])
            matrix = np.zeros((len(names), len(columns)))
            matrix[at, np.searchsorted(columns, pdf["_col"])] = pdf["_val"]
            dense.append(matrix)
            rows.append(names)
        product = dense[0] @ dense[1].T
        i, j = np.nonzero((dense[0] != 0).astype(float) @ (dense[1] != 0).astype(float).T)
        return pd.DataFrame({"a": rows[0][i], "b": rows[1][j], "dot": product[i, j]})

    parts = spread[0].groupBy(*keys).cogroup(spread[1].groupBy(*keys)).applyInPandas(multiply, f"a {kinds[0]}, b {kinds[1]}, dot double")
    return parts.groupBy("a", "b").agg(F.sum("dot").alias("dot"))
