"""Checks on record tables: each returns violating rows or counts, empty or zero when all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def count_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of two dictionaries and whether they agree."""
    n = left.agg(F.count(F.lit(1)).alias("left"))
    return n.withColumn("right", right.agg(F.count(F.lit(1))).scalar()).withColumn("same", (F.col("left") == F.col("right")).cast("int"))


def orphans(facts: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Fact rows whose key no parent has; repeated parent keys are folded first."""
    keys = parents.select(F.col(parent_key).alias("_pk")).distinct()
    return facts.join(keys, F.col(key) == F.col("_pk"), "left_anti")


def not_allowed(observed: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Observed combinations that the knowledge base does not have, with their row counts.

    Rows are counted per combination before the join, which then sees classes x codes rows.
    """
    counts = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(allowed.select(*keys).distinct(), keys, "left_anti")


def order_violations(rows: DataFrame, earlier: str, later: str, keys: list[str]) -> DataFrame:
    """Counts of rows whose ``later`` lies before ``earlier``, per key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(later) < F.col(earlier)).alias("violations"))


def set_differences(left: DataFrame, right: DataFrame, key: str, left_set: str, right_set: str) -> DataFrame:
    """Keys whose two sets differ or that one side lacks."""
    l = left.select(F.col(key).alias("_l"), F.array_sort(left_set).alias("_ls"))
    r = right.select(F.col(key).alias("_r"), F.array_sort(right_set).alias("_rs"))
    both = l.join(r, F.col("_l") == F.col("_r"), "full")
    return both.where(~F.col("_ls").eqNullSafe(F.col("_rs"))).select(F.coalesce("_l", "_r").alias(key))


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Value combinations whose row counts differ between two tables: (columns..., left, right)."""
    a = left.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = right.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    sums = a.unionByName(b).groupBy(*columns).agg(F.sum("_a").alias("left"), F.sum("_b").alias("right"))
    return sums.where(F.col("left") != F.col("right"))


def wrong_width(rows: DataFrame, width: Column, declared: int) -> DataFrame:
    """Rows whose vector does not have the declared width."""
    return rows.where(width.isNull() | (width != declared))
