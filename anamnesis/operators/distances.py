"""Distances between classes and between datasets, on (label, code, p) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .pairwise import dot_products
from .sizes import settle


def _norms(table: DataFrame, label: str, code: str, p: str) -> DataFrame:
    return table.groupBy(label).agg(
        F.sum(F.col(p) * F.col(p)).alias("_sq"), F.sum(p).alias("_sum"), F.count_if(F.col(p) > 0).alias("_nz")
    )


def _finish(pairs: DataFrame, width: Column) -> DataFrame:
    """Distances from dot products ``dot`` and ``common``, and the class sums of both sides."""
    dot, common = F.col("dot"), F.col("common")
    return pairs.select(
        *[c for c in ("a", "b", "other") if c in pairs.columns],
        (1 - F.try_divide(F.try_divide(dot, F.sqrt(F.col("_sq_a"))), F.sqrt(F.col("_sq_b")))).alias("cosine"),
        ((F.col("_nz_a") + F.col("_nz_b") - 2 * common) / width).alias("hamming"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("_sq_a") + F.col("_sq_b") - 2 * dot)).alias("euclidean"),
        ((F.col("_sum_a") + F.col("_sum_b") - 2 * dot) / width).alias("variability"),
    )


def class_sums(table: DataFrame, label: str, code: str, p: str) -> DataFrame:
    """Of all class pairs a < b: ``dot``, ``common``, and of each side the sum, the sum of squares and the number of values over 0.

    Pairs without a common code have a zero dot product and still get a row, as the pair list is
    the wanted result. Over whole numbers all sums are exact.
    """
    norms = settle(_norms(table, label, code, p))
    ids = norms.select(label).withColumn("_i", F.row_number().over(Window.orderBy(label)))
    dots = dot_products(table, label, code, p)
    # Result-sized: every class gets the list of the later ones.
    numbered = norms.join(ids, label)
    later = ids.agg(F.array_sort(F.collect_list(F.struct("_i", F.col(label).alias("_l")))).alias("l")).scalar()
    left = numbered.withColumn("_all", later)
    left = left.select(
        F.col(label).alias("a"),
        *[F.col(c).alias(f"{c}_a") for c in ("_sq", "_sum", "_nz")],
        F.explode(F.expr("slice(_all, _i + 1, size(_all))")).alias("_r"),
    ).withColumn("b", F.col("_r._l"))
    right = norms.select(F.col(label).alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("_sq", "_sum", "_nz")])
    pairs = left.join(right, "b").join(dots, ["a", "b"], "left").drop("_r")
    return pairs.withColumn("dot", F.coalesce("dot", F.lit(0.0))).withColumn("common", F.coalesce("common", F.lit(0)))


def class_distances(table: DataFrame, label: str, code: str, p: str, width: Column) -> DataFrame:
    """Cosine, Hamming (of p > 0), Euclidean distance and variability index of all class pairs a < b."""
    return _finish(class_sums(table, label, code, p), width)


def variability(hits: DataFrame, label: str, code: str, width: Column, digits: int = 6) -> DataFrame:
    """(a, b, variability) from (label, code, hits, n): the mean over all codes of the chance that of two rows, one of each class, just one shows the code.

    p = hits / n, so the index is (H_a n_b + H_b n_a - 2 sum(hits_a hits_b)) / (n_a n_b width) over whole numbers; it is rounded
    (half up) by whole division, so every engine and every order of rows gives the same digits.
    """
    sizes = hits.groupBy(label).agg(F.max("n").alias("_n"))
    pairs = class_sums(hits, label, code, "hits")
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col(label).alias(side), F.col("_n").alias(f"_n_{side}")), side)
    # 38 digits: classes of 10^9 rows over 10^7 codes.
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("_sum_a", "_sum_b", "dot", "_n_a", "_n_b")}
    top = whole["_sum_a"] * whole["_n_b"] + whole["_sum_b"] * whole["_n_a"] - 2 * whole["dot"]
    below = whole["_n_a"] * whole["_n_b"] * width.cast("decimal(10,0)")
    scale = 10**digits
    pairs = pairs.withColumns({"_top": top.cast("decimal(30,0)"), "_below": below.cast("decimal(37,0)")})
    rounded = F.expr(f"(2 * {scale} * _top + _below) div (2 * _below)")
    return pairs.select("a", "b", (rounded.cast("double") / float(scale)).alias("variability"))


def distances_to(table: DataFrame, label: str, code: str, p: str, target: object) -> DataFrame:
    """Cosine distance of every other class to one class."""
    table = settle(table)
    own = table.where(F.col(label) == target).select(code, F.col(p).alias("_p"))
    norms = _norms(table, label, code, p)
    own_sq = norms.where(F.col(label) == target).select("_sq").scalar()
    dots = (
        table.where(F.col(label) != target)
        .join(own, code, "left")
        .groupBy(label)
        .agg(F.sum(F.col(p) * F.coalesce("_p", F.lit(0.0))).alias("dot"), F.sum(F.col(p) * F.col(p)).alias("_sq"))
    )
    return dots.select(F.col(label).alias("other"), (1 - F.col("dot") / F.sqrt("_sq") / F.sqrt(own_sq)).alias("cosine"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both orders of every pair."""
    swapped = pairs.withColumnsRenamed({"a": "_t", "b": "a"}).withColumnRenamed("_t", "b")
    return pairs.unionByName(swapped)


def drift(
    table: DataFrame, dataset: str, base: object, label: str, code: str, p: str
) -> DataFrame:
    """KL divergence of every variant from the base, per class.

    ``kl_base``     both sides renormalised on the codes the base shows
    ``kl_variant``  both sides renormalised on the codes the variant shows (base-only codes are
                    counted in ``missing``)
    A code the base shows and the variant does not makes ``kl_base`` infinite: it is NULL then.
    """
    base_rows = table.where(F.col(dataset) == base).select(label, code, F.col(p).alias("_p"))
    variants = table.where(F.col(dataset) != base).select(dataset, label, code, F.col(p).alias("_q"))
    names = variants.select(dataset).distinct()
    names_list = names.agg(F.array_sort(F.collect_list(dataset)).alias("n")).scalar()
    spread = base_rows.withColumn(dataset, F.explode(names_list))
    both = spread.join(variants, [dataset, label, code], "full").fillna(0.0, ["_p", "_q"])

    def log_sum(on: Column) -> tuple[Column, Column, Column]:
        return (
            F.sum(F.when(on & (F.col("_p") > 0), F.col("_p") * F.ln(F.col("_p") / F.col("_q")))),
            F.sum(F.when(on, F.col("_p"))),
            F.sum(F.when(on, F.col("_q"))),
        )

    on_base, on_variant = F.col("_p") > 0, F.col("_q") > 0
    s1, p1, q1 = log_sum(on_base & on_variant)
    s2, p2, q2 = log_sum(on_variant)
    sums = both.groupBy(dataset, label).agg(
        s1.alias("s1"),
        F.sum(F.when(on_base, F.col("_p"))).alias("p1"),
        F.sum(F.when(on_base, F.col("_q"))).alias("q1"),
        s2.alias("s2"),
        p2.alias("p2"),
        q2.alias("q2"),
        F.count_if(on_base & ~on_variant).alias("missing"),
    )
    # sum (p/P) ln((p/P) / (q/Q)) = (sum p ln(p/q)) / P + ln(Q / P)
    return sums.select(
        dataset,
        label,
        "missing",
        F.when(F.col("missing") == 0, F.col("s1") / F.col("p1") + F.ln(F.col("q1") / F.col("p1"))).alias("kl_base"),
        (F.col("s2") / F.col("p2") + F.ln(F.col("q2") / F.col("p2"))).alias("kl_variant"),
    )


def wasserstein(table: DataFrame, dataset: str, base: object, label: str, code: str, p: str) -> DataFrame:
    """1-D Wasserstein distance of the sorted probabilities of each class to those of the base.

    Both samples are taken on the codes the base shows, so they have equal size; a code the
    variant lacks counts 0. A window partition holds one class of one dataset: at most the
    dictionary.
    """
    base_rows = table.where((F.col(dataset) == base) & (F.col(p) > 0)).select(label, code, F.col(p).alias("_p"))
    names_list = table.where(F.col(dataset) != base).agg(F.array_sort(F.collect_set(dataset)).alias("n")).scalar()
    spread = base_rows.withColumn(dataset, F.explode(names_list))
    variants = table.where(F.col(dataset) != base).select(dataset, label, code, F.col(p).alias("_q"))
    both = spread.join(variants, [dataset, label, code], "left").fillna(0.0, ["_q"])
    sides = both.groupBy(dataset, label).agg(
        F.array_sort(F.collect_list("_p")).alias("u"), F.array_sort(F.collect_list("_q")).alias("v")
    )
    gaps = F.zip_with("u", "v", lambda a, b: F.abs(a - b))
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)
    return sides.select(dataset, label, (total / F.size("u")).alias("distance"))


def drift_summary(distances: DataFrame, dataset: str, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation over the classes, per dataset."""
    picks = []
    for c in columns:
        picks += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_n")]
    return distances.groupBy(dataset).agg(*picks)
