"""Group statistics beyond a plain aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import exact_quantiles
from .sizes import settle, small_side


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count of every integer in [min, max], zeros included: (value, n)."""
    present = df.where(F.col(column).isNotNull())
    counts = settle(present.groupBy(F.col(column).cast("bigint").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    ends = counts.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    every = ends.select(F.explode(F.sequence("a", "b")).alias("value"))
    return every.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def histogram(df: DataFrame, column: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per bin [k * width, (k + 1) * width): (keys..., bin_start, n)."""
    start = (F.floor(F.col(column) / width) * width).cast("double")
    return df.groupBy(*keys, start.alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """Quartiles and whiskers (the last value within 1.5 IQR of the box) per group."""
    q = exact_quantiles(df, group, column, [0.25, 0.5, 0.75])
    picks = [F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "med"), (0.75, "q3"))]
    box = q.groupBy(*group).agg(*picks)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    named = box.withColumnsRenamed({g: f"_box_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_box_{g}"))
    joined = df.join(small_side(settle(named)), same)
    inside = (F.col(column) >= F.col("q1") - reach) & (F.col(column) <= F.col("q3") + reach)
    return joined.groupBy(*group).agg(
        *[F.max(c).alias(c) for c in ("q1", "med", "q3")],
        F.min(F.when(inside, F.col(column))).alias("whisker_low"),
        F.max(F.when(inside, F.col(column))).alias("whisker_high"),
    )


def size_bands(df: DataFrame, label: str) -> DataFrame:
    """Class sizes with their distance from the mean size in whole standard deviations; NULL where all sizes are equal."""
    sizes = settle(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))
    stats = sizes.agg(F.struct(F.avg("n").alias("m"), F.stddev_samp("n").alias("s")).alias("s")).scalar()
    work = sizes.withColumn("_s", stats)
    return work.withColumn("band", F.floor(F.try_divide(F.col("n") - F.col("_s.m"), F.col("_s.s"))).cast("bigint")).drop("_s")


def flag_union(facts: DataFrame, key: str, code: str, constants: DataFrame) -> DataFrame:
    """Fold rows to one per key, the union of their codes, and add the constants of the key.

    The codes are folded before the join, so a key with very many rows is one row there.
    """
    folded = facts.groupBy(key).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    return folded.join(constants, key, "left")


def extreme_rows(df: DataFrame, pick: Column, by: Column) -> DataFrame:
    """Value of ``pick`` at the largest and the smallest ``by``, in one aggregate."""
    return df.agg(
        F.max_by(pick, by).alias("at_max"), F.max(by).alias("max"), F.min_by(pick, by).alias("at_min"), F.min(by).alias("min")
    )
