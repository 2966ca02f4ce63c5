"""Reproducible splits in hash order: exact per class, whatever the size of a class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import hash_rank, value_rank


def stratified_split(
    df: DataFrame, label: str, ids: Sequence[str], train: float, seed: object = 0, rounding: str = "round"
) -> DataFrame:
    """Add ``split``: the first ``train`` share of each class in hash order is ``train``, the rest ``test``."""
    ranked = hash_rank(df, [label], seed, ids)
    size = F.ceil(F.col("n") * train) if rounding == "ceil" else F.round(F.col("n") * train)
    return ranked.withColumn("split", F.when(F.col("rn") <= size, "train").otherwise("test")).drop("rn", "n")


def head_split(df: DataFrame, label: str, order: str, train: float) -> DataFrame:
    """First ceil(train * n) rows of each class in file order are ``train``."""
    ranked = value_rank(df, [label], order)
    cut = F.ceil(F.col("n") * train)
    return ranked.withColumn("split", F.when(F.col("rn") <= cut, "train").otherwise("test")).drop("rn", "n")


def first_per_class(df: DataFrame, label: str, order: str, count: int) -> DataFrame:
    """First ``count`` rows of each class are ``train``, the rest ``validation``."""
    ranked = value_rank(df, [label], order)
    return ranked.withColumn("split", F.when(F.col("rn") <= count, "train").otherwise("validation")).drop("rn", "n")


def positional_split(df: DataFrame, order: str, train: int = 70, validation: int = 10) -> DataFrame:
    """Whole-file cuts at floor(percent * n / 100) in file order: train, val, test."""
    ranked = value_rank(df, [], order)
    first = F.floor(F.col("n") * train / 100)
    second = first + F.floor(F.col("n") * validation / 100)
    part = F.when(F.col("rn") <= first, "train").when(F.col("rn") <= second, "val").otherwise("test")
    return ranked.withColumn("split", part).drop("rn", "n")


def balance_classes(df: DataFrame, label: str, ids: Sequence[str], share: float = 0.95, seed: object = 0) -> DataFrame:
    """Cut every class to floor(share * smallest class): ``train``; what is over is ``validation``."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    keep = sizes.agg(F.floor(F.min("_n") * share).alias("keep")).scalar()
    ranked = hash_rank(df, [label], seed, ids)
    return ranked.withColumn("split", F.when(F.col("rn") <= keep, "train").otherwise("validation")).drop("rn", "n")


def kfold(df: DataFrame, label: str, ids: Sequence[str], k: int, seed: object = 0) -> DataFrame:
    """Add ``fold`` 0..k-1, dealt in hash order within each class."""
    return hash_rank(df, [label], seed, ids).withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn", "n")


def learning_fractions(
    df: DataFrame, label: str, ids: Sequence[str], fractions: Sequence[float], seed: object = 0
) -> DataFrame:
    """Add ``level``: the position of the smallest fraction whose nested subsample has the row."""
    ranked = hash_rank(df, [label], seed, ids)
    level: Column = F.lit(None).cast("int")
    for i in reversed(range(len(fractions))):
        level = F.when(F.col("rn") <= F.round(F.col("n") * fractions[i]), i).otherwise(level)
    return ranked.withColumn("level", level).drop("rn", "n")


def holdout_folds(df: DataFrame, label: str, ids: Sequence[str], folds: int, train: float = 0.8) -> DataFrame:
    """One seeded split per fold (the folds overlap): a row per fold with its part."""
    repeated = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    ranked = hash_rank(repeated, [label, "fold"], "fold", ["fold", *ids])
    part = F.when(F.col("rn") <= F.round(F.col("n") * train), "train").otherwise("test")
    return ranked.withColumn("split", part).drop("rn", "n")


def mix_sources(
    df: DataFrame, source: str, label: str, ids: Sequence[str], percents: Mapping[str, int], seed: object = 0
) -> DataFrame:
    """Keep a stratified share of each source; a source without a percentage is left out."""
    pairs = [F.lit(x) for item in percents.items() for x in item]
    tagged = df.withColumn("_pct", F.try_element_at(F.create_map(*pairs), F.col(source))).where(F.col("_pct").isNotNull())
    ranked = hash_rank(tagged, [source, label], seed, ids)
    return ranked.where(F.col("rn") <= F.round(F.col("n") * F.col("_pct") / 100)).drop("rn", "n", "_pct")
