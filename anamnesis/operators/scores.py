"""Scores over run tables: normalised sums, near-best filters, fronts, shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import value_buckets
from .sizes import settle


def normalised(runs: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """Add (x - min) / (max - min) of each column, NULL for a constant one; the ends come from one aggregate."""
    runs = settle(runs)
    ends = runs.agg(F.struct(*[x for c in columns for x in (F.min(c).alias(f"{c}_a"), F.max(c).alias(f"{c}_b"))]).alias("e"))
    work = runs.withColumn("_e", ends.scalar())
    for c in columns:
        low, high = F.col(f"_e.{c}_a"), F.col(f"_e.{c}_b")
        work = work.withColumn(c + suffix, F.try_divide(F.col(c) - low, high - low))
    return work.drop("_e")


def weighted_score(weights: Mapping[str, float], suffix: str = "_norm") -> Column:
    total: Column = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name + suffix) * F.lit(float(weight))
    return total


def near_best(runs: DataFrame, score: str, tolerance: float) -> DataFrame:
    """Runs whose score is at least max * (1 - tolerance)."""
    runs = settle(runs)
    best = runs.agg(F.max(score)).scalar()
    return runs.where(F.col(score) >= best * F.lit(1 - tolerance))


def pareto_front(runs: DataFrame, score: str, cost: str) -> DataFrame:
    """Runs that no cheaper (or equally cheap) run beats.

    The best score before a run is the running maximum in its cost range, or the best of the
    cheaper ranges.
    """
    work = value_buckets(settle(runs), cost)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = work.groupBy("_bucket").agg(F.max(score).alias("_m")).select("_bucket", F.max("_m").over(earlier).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(cost, F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    # At most MAX_BUCKETS + 1 rows are broadcast.
    joined = work.join(F.broadcast(ranges), "_bucket").withColumn("_best", F.greatest("_before", F.max(score).over(inside)))
    return joined.where(F.col("_best").isNull() | (F.col(score) > F.col("_best"))).drop("_bucket", "_before", "_best")


def shares(df: DataFrame, keys: Sequence[str], weight: str, scale: float = 1.0, out: str = "share") -> DataFrame:
    """weight / (scale * sum of the weights of the key); a key is one condition and attribute kind."""
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.try_divide(F.col(weight), F.lit(scale) * total))


def standardised(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - mean) / sample deviation; NULL for a constant column."""
    stats = df.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).alias("s")).scalar()
    return df.withColumn("_s", stats).withColumn(out, F.try_divide(F.col(column) - F.col("_s.m"), F.col("_s.s"))).drop("_s")
