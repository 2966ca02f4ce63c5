"""Worked examples of the scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.functions import maths as M
from anamnesis.operators import evaluation as V

# Sixteen labels and predictions, and five rows of ten class scores of which three
# have their label among the first five.
TRUE = [0, 1, 2, 1, 1, 3, 1, 2, 3, 0, 2, 3, 2, 0, 3, 0]
PREDICTED = [0, 3, 0, 2, 3, 2, 0, 3, 2, 1, 3, 1, 1, 2, 1, 0]
SCORES = [
    [0.1270, 0.3182, 0.7561, 0.2694, 0.8137, 0.4122, 0.0514, 0.0417, 0.2929, 0.3658],
    [0.2220, 0.6216, 0.3743, 0.3379, 0.8600, 0.2977, 0.5080, 0.5919, 0.3067, 0.7062],
    [0.5227, 0.5934, 0.6640, 0.9494, 0.9338, 0.0082, 0.6514, 0.4110, 0.0067, 0.7598],
    [0.1915, 0.4978, 0.8259, 0.1727, 0.1590, 0.3756, 0.2304, 0.7274, 0.3615, 0.2914],
    [0.5394, 0.1803, 0.6762, 0.0320, 0.5921, 0.3524, 0.3931, 0.8371, 0.7799, 0.4619],
]
TARGET = [2, 0, 1, 8, 7]


def ranked(spark, scores, target):
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(zip(scores, target))], "id int, s array<double>, label int")
    return df.withColumn("top", M.ranked(F.col("s"), 5)).withColumn("own", M.at_label(F.col("s"), F.col("label")))


def test_top_five_example(spark):
    rows = ranked(spark, SCORES, TARGET)
    assert V.accuracy(rows, "label").first()["top_5"] == pytest.approx(0.6)
    tops = [V.accuracy(rows, "label", tops=(k,)).first()[f"top_{k}"] for k in range(1, 6)]
    assert tops == sorted(tops)


def test_zero_probability_does_not_count(spark):
    rows = ranked(spark, [[0.0, 1.0, 0.0], [0.2, 0.5, 0.3]], [0, 0])
    assert V.accuracy(rows, "label").first()["top_5"] == 0.5
    assert rows.agg(F.avg(V.top_hit("label", 5, False).cast("double"))).first()[0] == 1.0


def test_precision_example(spark):
    df = spark.createDataFrame([(str(t), [(str(p), 1.0)]) for t, p in zip(TRUE, PREDICTED)], "label string, top array<struct<label:string,p:double>>")
    scores = {r.label: r for r in V.class_scores(V.confusion(df, "label")).collect()}
    cm = np.zeros((4, 4))
    for t, p in zip(TRUE, PREDICTED):
        cm[t, p] += 1
    for c in range(4):
        assert scores[str(c)].precision == pytest.approx(cm[c, c] / cm[:, c].sum())
        assert scores[str(c)].recall == pytest.approx(cm[c, c] / cm[c].sum())
    means = V.averaged_scores(V.class_scores(V.confusion(df, "label"))).first()
    weights = cm.sum(axis=1) / cm.sum()
    assert means.precision_weighted == pytest.approx(sum(weights[c] * scores[str(c)].precision for c in range(4)))


def test_zero_division(spark):
    df = spark.createDataFrame([("a", [("a", 1.0)]), ("b", [("a", 1.0)])], "label string, top array<struct<label:string,p:double>>")
    assert {r.label: r.precision for r in V.class_scores(V.confusion(df, "label"), zero_division=1.0).collect()} == {"a": 0.5, "b": 1.0}


def brute_auc(pos, neg):
    return np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg])


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(3)
    labels = rng.choice(["a", "b", "c"], 150, p=[0.6, 0.3, 0.1])
    scores = np.round(rng.random((150, 3)), 1)
    data = [(str(y), list(zip("abc", map(float, s)))) for y, s in zip(labels, scores)]
    df = spark.createDataFrame(data, "label string, top array<struct<label:string,p:double>>")
    got = {r.cand: r.auc for r in V.auc_one_vs_rest(df, "label").collect()}
    for i, c in enumerate("abc"):
        assert got[c] == pytest.approx(brute_auc(scores[labels == c, i], scores[labels != c, i]))
    pairs = {(r.a, r.b): r.auc for r in V.auc_pairs(df, "label").collect()}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        a, b = "abc"[i], "abc"[j]
        one = brute_auc(scores[labels == a, i], scores[labels == b, i])
        two = brute_auc(scores[labels == b, j], scores[labels == a, j])
        assert pairs[a, b] == pytest.approx((one + two) / 2)


def test_threshold_sweep_against_loop(spark):
    rng = np.random.default_rng(4)
    p = rng.random(200)
    label, top = rng.integers(0, 3, 200), rng.integers(0, 3, 200)
    data = [(str(y), [(str(t), float(x)), (str((t + 1) % 3), 0.0)]) for y, t, x in zip(label, top, p)]
    df = spark.createDataFrame(data, "label string, top array<struct<label:string,p:double>>").withColumn("own", F.lit(0.5))
    for r in V.threshold_sweep(df, "label", [0.0, 0.3, 0.99, 2.0]).collect():
        keep = p >= r.threshold
        assert (r.allowed, r.rejected) == (keep.sum(), (~keep).sum())
        assert r.allowed_top1 == (keep & (label == top)).sum()
        assert r.rejected_topn == (~keep & ((label == top) | (label == (top + 1) % 3))).sum()
