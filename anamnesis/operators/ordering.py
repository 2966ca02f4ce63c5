"""Exact ranks, running sums, fills and quantiles that never put a whole group into one task.

Rows are first placed in buckets that follow the wanted order (a prefix of a hash, or the
quantile range of a number). Windows then run per (group, bucket); what the earlier buckets of
the group hold is added from a bucket table of at most groups x buckets rows. A class with a
third of all rows is thereby spread over as many tasks as there are buckets.

NULL is a group of its own: groups are matched by text keys in which it has a mark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Hexadecimal digits of a hash bucket, at least; more where there are more shuffle partitions.
HASH_DIGITS = 3
#: Quantile ranges of a number, at most: their limits are part of the plan.
MAX_BUCKETS = 1 << 16


def hash_key(seed: object, *ids: str | Column) -> Column:
    """A reproducible random order: md5 of ``seed-id[-id...]``."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]))


def hash_unit(key: Column) -> Column:
    """The first 32 bits of a hash key as a number in (0, 1)."""
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def value_buckets(df: DataFrame, column: str, out: str = "_bucket", buckets: int | None = None) -> DataFrame:
    """Add the quantile range of a numeric column: -1 for NULL, which sorts first, and a last one of its own for NaN."""
    if buckets is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(8, min(MAX_BUCKETS, 4 * parts))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.select(F.col(column).cast("double").alias("_v")).approxQuantile("_v", probs, 1.0 / (2 * buckets))
    splits = [float("-inf"), *sorted(set(cuts or [0.0])), float("inf")]
    work = df.withColumn("_v", F.col(column).cast("double"))
    work = Bucketizer(splits=splits, inputCol="_v", outputCol=out, handleInvalid="keep").transform(work)
    return work.drop("_v").withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(-1)))


def _group_keys(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add a text key per group column that is never NULL, so that joins keep all rows."""
    keys = {f"_g{i}": F.coalesce(F.col(c).cast("string"), F.lit("\0")) for i, c in enumerate(group)}
    return (df.withColumns(keys) if keys else df), list(keys)


def _with_offsets(df: DataFrame, group: Sequence[str], bucket: str, amount: Column) -> DataFrame:
    """Join what the earlier buckets of the group sum to (``_off``) and the group's sum (``_all``)."""
    per_bucket = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_part"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *group,
        bucket,
        F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_off"),
        F.sum("_part").over(whole).alias("_all"),
    )
    if not group:
        # One row a bucket: some times the number of shuffle partitions.
        offsets = F.broadcast(offsets)
    return df.join(offsets, [*group, bucket])


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    bucket: str,
    amount: Column,
    out: str = "before",
    total: str = "total",
) -> DataFrame:
    """Add the sum of ``amount`` over the earlier rows of the group, and over the whole group.

    ``bucket`` must never fall as ``order`` rises, and ``order`` must have no ties.
    """
    keyed, keys = _group_keys(df, group)
    work = _with_offsets(keyed, keys, bucket, amount)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return work.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)) + F.col("_off")).withColumnRenamed(
        "_all", total
    ).drop("_off", *keys)


def hash_rank(
    df: DataFrame, group: Sequence[str], seed: object, ids: Sequence[str], rank: str = "rn", total: str = "n"
) -> DataFrame:
    """1-based rank of each row in its group in hash order, and the size of the group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = max(HASH_DIGITS, len(f"{4 * parts - 1:x}"))
    work = df.withColumn("_key", hash_key(seed, *ids)).withColumn("_bucket", F.substring("_key", 1, digits))
    work = running_sum(work, group, ["_key", *ids], "_bucket", F.lit(1), "_before", total)
    return work.withColumn(rank, F.col("_before") + 1).drop("_key", "_bucket", "_before")


def value_rank(
    df: DataFrame,
    group: Sequence[str],
    column: str,
    ties: Sequence[str] = (),
    rank: str = "rn",
    total: str = "n",
    descending: bool = False,
) -> DataFrame:
    """1-based rank by a numeric column (ties broken by further columns), and the size of the group.

    NULL comes first, in descending order last.
    """
    work = value_buckets(df, column)
    order: list[Column] = [F.col(column), *[F.col(c) for c in ties]]
    if descending:
        work = work.withColumn("_bucket", -F.col("_bucket"))
        order[0] = F.col(column).desc()
    work = running_sum(work, group, order, "_bucket", F.lit(1), "_before", total)
    return work.withColumn(rank, F.col("_before") + 1).drop("_bucket", "_before")


def row_index(df: DataFrame, column: str, out: str = "Index") -> DataFrame:
    """0-based position in the order of a unique numeric column, over the whole table."""
    return value_rank(df, [], column, rank="_rn", total="_n").withColumn(out, F.col("_rn") - 1).drop("_rn", "_n")


def forward_fill(df: DataFrame, order: str, columns: Sequence[str], suffix: str = "_filled") -> DataFrame:
    """Last non-NULL value at or before each row, in the order of a unique numeric column; rows with a NULL order come first."""
    work = value_buckets(df, order)
    last = work.groupBy("_bucket").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{c}") for c in columns]
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(
        "_bucket", *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in columns]
    )
    # At most MAX_BUCKETS + 1 rows.
    work = work.join(F.broadcast(carried), "_bucket")
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for c in columns:
        filled = F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}"))
        work = work.withColumn(f"{c}{suffix}", filled)
    return work.drop("_bucket", *[f"_c_{c}" for c in columns])


def exact_quantiles(df: DataFrame, group: Sequence[str], column: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row (group, prob, value) each.

    Equal values are counted first; of the value table only the buckets that hold a wanted rank
    are sorted.
    """
    counts = (
        value_buckets(df.where(F.col(column).isNotNull()), column)
        .groupBy(*group, "_bucket", column)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counts, keys = _group_keys(counts, group)
    placed = _with_offsets(counts, keys, "_bucket", F.col("_n"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    bucket_rows = Window.partitionBy(*keys, "_bucket")
    # Rank positions are 0-based: the value at position h = (total - 1) * p.
    hit = F.exists(
        wanted,
        lambda p: (F.ceil((F.col("_all") - 1) * p) >= F.col("_off"))
        & (F.floor((F.col("_all") - 1) * p) < F.col("_off") + F.col("_size")),
    )
    rows = (
        placed.withColumn("_size", F.sum("_n").over(bucket_rows))
        .where(hit)
        .withColumn("_lo", F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .withColumn("_hi", F.col("_lo") + F.col("_n"))
        .withColumn("prob", F.explode(wanted))
        .withColumn("_h", (F.col("_all") - 1) * F.col("prob"))
    )

    def at(position: Column) -> Column:
        return F.max(F.when((position >= F.col("_lo")) & (position < F.col("_hi")), F.col(column)))

    picked = rows.groupBy(*group, "prob").agg(
        at(F.floor("_h")).alias("_low"), at(F.ceil("_h")).alias("_high"), F.max(F.col("_h") - F.floor("_h")).alias("_f")
    )
    return picked.select(
        *group, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_f")).cast("double").alias("value")
    )
