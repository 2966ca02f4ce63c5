"""Class-conditional symptom rates and what a class does not show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def class_rates(rows: DataFrame, label: str, codes: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., label, code, hits, n, rate): share of the class's rows that show the code.

    One pass over the rows: a marker code counts the class itself, so class sizes and code hits
    come out of the same partial aggregate; only classes x codes rows are shuffled.
    """
    group = [*keys, label]
    marker = F.array(F.lit(None).cast("string"))
    flat = rows.select(*group, F.explode(F.concat(marker, F.array_distinct(codes))).alias("code"))
    counts = flat.groupBy(*group, "code").agg(F.count(F.lit(1)).alias("hits"))
    # A window partition holds one class: at most the dictionary and the marker.
    size = F.max(F.when(F.col("code").isNull(), F.col("hits"))).over(Window.partitionBy(*group))
    return (
        counts.withColumn("n", size)
        .where(F.col("code").isNotNull())
        .select(*group, "code", "hits", "n", (F.col("hits") / F.col("n")).alias("rate"))
    )


def absent_codes(own: DataFrame, condition: str, code: str, vocabulary: DataFrame) -> DataFrame:
    """(condition, code) for every vocabulary code the condition lacks.

    The vocabulary (a dictionary) reaches each condition as one array, so no pair that is present
    is ever made.
    """
    words = vocabulary.agg(F.collect_set(F.col(code).cast("string")).alias("w")).scalar()
    sets = own.groupBy(condition).agg(F.collect_set(code).alias("_own")).withColumn("_all", words)
    return sets.select(condition, F.explode(F.array_except("_all", "_own")).alias(code))
