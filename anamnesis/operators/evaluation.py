"""Scores of predictions: one row per record with its label, its top classes and the label's own p."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import running_sum, value_buckets
from .sizes import store


def predicted() -> Column:
    return F.get("top", 0)["label"]


def top_hit(label: str, count: int, require_positive: bool = True) -> Column:
    """Whether the label is among the first ``count`` classes (and, by default, has p > 0)."""
    found = F.array_contains(F.transform(F.slice("top", 1, count), lambda s: s["label"]), F.col(label))
    return found & (F.col("own") > 0) if require_positive else found


def accuracy(rows: DataFrame, label: str, keys: Sequence[str] = (), tops: Sequence[int] = (1, 5)) -> DataFrame:
    """(keys..., n, top_k...) in one aggregate."""
    picks = [F.avg(top_hit(label, k).cast("double")).alias(f"top_{k}") for k in tops]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *picks)


def confusion(rows: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., truth, pred, n)."""
    return rows.groupBy(*keys, F.col(label).alias("truth"), predicted().alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(cells: DataFrame, keys: Sequence[str] = (), zero_division: float = 0.0) -> DataFrame:
    """(keys..., label, support, predicted, tp, precision, recall, f1) from confusion counts.

    Works on the classes x classes table only: each cell adds to its true and its predicted class.
    """
    same = F.col("truth") == F.col("pred")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(same, F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )
    sums = cells.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, "s.label").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp")
    )
    tp, zero = F.col("tp"), F.lit(zero_division)
    scored = sums.withColumn("precision", F.when(F.col("predicted") > 0, tp / F.col("predicted")).otherwise(zero)).withColumn(
        "recall", F.when(F.col("support") > 0, tp / F.col("support")).otherwise(zero)
    )
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def averaged_scores(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted means of precision, recall and f1."""
    picks = []
    for name in ("precision", "recall", "f1"):
        picks.append(F.avg(name).alias(f"{name}_macro"))
        picks.append((F.sum(F.col(name) * F.col("support")) / F.sum("support")).alias(f"{name}_weighted"))
    return scores.groupBy(*keys).agg(*picks)


def auc_one_vs_rest(scored: DataFrame, label: str) -> DataFrame:
    """(cand, positives, auc): rank-sum area per class, ties counted half.

    ``top`` must hold all classes. A class without positive or without negative rows has a NULL area. Rows are first counted per class and distinct score; that table
    is written once, and the running sum sees each score once.
    """
    flat = scored.select(F.col(label).alias("_l"), F.explode("top").alias("t")).select("_l", F.col("t.label").alias("cand"), F.col("t.p").alias("p"))
    hit = (F.col("_l") == F.col("cand")).cast("bigint")
    counts = store(flat.groupBy("cand", "p").agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")), "scores")
    counts = value_buckets(counts, "p")
    below = running_sum(counts, ["cand"], ["p"], "_bucket", F.col("neg"), "below", "negatives")
    sums = below.groupBy("cand").agg(
        F.sum("pos").alias("positives"),
        F.max("negatives").alias("negatives"),
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"),
    )
    return sums.select("cand", "positives", F.try_divide(F.try_divide("u", "positives"), F.col("negatives")).alias("auc"))


def auc_pairs(scored: DataFrame, label: str) -> DataFrame:
    """(a, b, auc): for a < b the mean of the areas of a against b and b against a, each on the rows of the two classes."""
    flat = scored.select(F.col(label).alias("_l"), F.explode("top").alias("t")).select("_l", F.col("t.label").alias("cand"), F.col("t.p").alias("p"))
    # Counts per (class, distinct score, true class): the own rows are positive against every other class.
    counts = store(flat.groupBy("cand", "p", "_l").agg(F.count(F.lit(1)).alias("n")), "scores")
    classes = counts.agg(F.collect_set("_l").alias("c")).scalar()
    counts = value_buckets(counts, "p")
    rivals = F.when(F.col("_l") == F.col("cand"), F.array_except("_c", F.array("cand"))).otherwise(F.array("_l"))
    spread = counts.withColumn("_c", classes).withColumn("rival", F.explode(rivals))
    own = F.col("_l") == F.col("cand")
    split = spread.groupBy("cand", "rival", "_bucket", "p").agg(
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(own, 0).otherwise(F.col("n"))).alias("neg")
    )
    below = running_sum(split, ["cand", "rival"], ["p"], "_bucket", F.col("neg"), "below", "negatives")
    sums = below.groupBy("cand", "rival").agg(
        F.sum("pos").alias("positives"), F.max("negatives").alias("negatives"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u")
    )
    one = sums.select(F.least("cand", "rival").alias("a"), F.greatest("cand", "rival").alias("b"), F.try_divide(F.try_divide("u", "positives"), F.col("negatives")).alias("auc"))
    return one.groupBy("a", "b").agg(F.avg("auc").alias("auc"))


def confidence_buckets(rows: DataFrame, label: str, count: int = 5) -> DataFrame:
    """(bucket, rank, p) rows: every record is in ``all``, in right or wrong, and in or out of the top."""
    right, inside = predicted() == F.col(label), top_hit(label, count)
    tags = F.array(
        F.lit("all"),
        F.when(right, "top1_right").otherwise("top1_wrong"),
        F.when(inside, f"in_top{count}").otherwise(f"not_in_top{count}"),
    )
    flat = rows.select(F.explode(tags).alias("bucket"), F.posexplode(F.slice("top", 1, count)).alias("rank", "t"))
    return flat.select("bucket", (F.col("rank") + 1).alias("rank"), F.col("t.p").alias("p"))


def threshold_sweep(rows: DataFrame, label: str, thresholds: Sequence[float], count: int = 5) -> DataFrame:
    """Allowed and rejected counts, and their top-1 and top-n hits, per threshold.

    Each record is counted once in the interval its best p falls in; the intervals are then
    summed from the top. No record is repeated per threshold.
    """
    cuts = sorted(set(float(x) for x in thresholds))
    best = F.get("top", 0)["p"]
    level: Column = F.lit(0)
    for c in cuts:
        level = level + (best >= c).cast("int")
    one, top = (predicted() == F.col(label)).cast("bigint"), top_hit(label, count, False).cast("bigint")
    counts = rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("t1"), F.sum(top).alias("tn"))
    # Number of thresholds + 1 rows from here on.
    table = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(c).alias("threshold")) for i, c in enumerate(cuts)])
    flat = counts.select("level", "n", "t1", "tn", F.explode(table).alias("c")).select("level", "n", "t1", "tn", "c.*")
    up = F.col("level") >= F.col("i")

    def part(name: str, allowed: bool) -> Column:
        return F.coalesce(F.sum(F.when(up if allowed else ~up, F.col(name))), F.lit(0)).cast("bigint")

    return flat.groupBy("threshold").agg(
        part("n", True).alias("allowed"),
        part("t1", True).alias("allowed_top1"),
        part("tn", True).alias("allowed_topn"),
        part("n", False).alias("rejected"),
        part("t1", False).alias("rejected_top1"),
        part("tn", False).alias("rejected_topn"),
    )


def threshold_summary(sweep: DataFrame) -> DataFrame:
    """Share diagnosed and accuracy among the diagnosed, per threshold."""
    n = F.col("allowed")
    return sweep.select(
        "threshold",
        (n / (n + F.col("rejected"))).alias("diagnosed"),
        F.when(n > 0, F.col("allowed_top1") / n).alias("top1"),
        F.when(n > 0, F.col("allowed_topn") / n).alias("topn"),
    )


def misfires(rows: DataFrame, label: str, count: int = 5) -> DataFrame:
    """(truth, inside, pred, n): the other classes in the top of each record, by whether the label is in it."""
    inside = top_hit(label, count, False).cast("int")
    flat = rows.select(F.col(label).alias("truth"), inside.alias("inside"), F.explode(F.slice("top", 1, count)).alias("t"))
    return flat.where(F.col("t.label") != F.col("truth")).groupBy("truth", "inside", F.col("t.label").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def ranked_misfires(cells: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """First ``count`` predicted classes per key by frequency, ties by class; at most classes rows per key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "pred"))
    return cells.withColumn("rank", place).where(F.col("rank") <= count)
