"""Pairwise products, variants, drift and folds against brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from anamnesis.operators import distances as D
from anamnesis.operators import folds as K
from anamnesis.operators import pairwise as P
from anamnesis.operators import quality as Q
from anamnesis.operators import rates as B
from anamnesis.operators import records as R
from anamnesis.operators import variants as V


def dense_table(spark, rows=40, columns=15, seed=0):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((rows, columns)) < 0.3, rng.random((rows, columns)), 0)
    m[:, 0] = 0.5
    data = [(f"r{i:03d}", f"c{j:02d}", float(m[i, j])) for i in range(rows) for j in range(columns) if m[i, j] > 0]
    return m, spark.createDataFrame(data, "label string, code string, p double")


def test_dot_products_over_several_blocks(spark):
    m, df = dense_table(spark)
    got = {(r.a, r.b): r.dot for r in P.dot_products(df, "label", "code", "p", 7, 4).collect()}
    for i in range(40):
        for j in range(i + 1, 40):
            assert abs(got.get((f"r{i:03d}", f"r{j:03d}"), 0.0) - m[i] @ m[j]) < 1e-9
    assert all(a < b for a, b in got)


def test_class_distances(spark):
    m, df = dense_table(spark, 12, 9, 1)
    got = {(r.a, r.b): r for r in D.class_distances(df, "label", "code", "p", F.lit(9)).collect()}
    assert len(got) == 66
    for (a, b), r in got.items():
        x, y = m[int(a[1:])], m[int(b[1:])]
        assert abs(r.euclidean - np.linalg.norm(x - y)) < 1e-6
        assert abs(r.cosine - (1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y))) < 1e-9
        assert abs(r.hamming - np.mean((x > 0) != (y > 0))) < 1e-9
        assert abs(r.variability - (x.sum() + y.sum() - 2 * x @ y) / 9) < 1e-9


def test_drift(spark):
    data = [("base", "c", "x", 0.5), ("base", "c", "y", 0.25), ("var", "c", "x", 0.25), ("var", "c", "y", 0.5), ("var", "c", "z", 0.1),
            ("base", "d", "x", 0.5), ("base", "d", "y", 0.5), ("var", "d", "x", 0.5)]
    df = spark.createDataFrame(data, "ds string, label string, code string, p double")
    got = {r.label: r for r in D.drift(df, "ds", "base", "label", "code", "p").collect()}
    p, q = np.array([0.5, 0.25]) / 0.75, np.array([0.25, 0.5]) / 0.75
    assert abs(got["c"].kl_base - (p * np.log(p / q)).sum()) < 1e-9
    q3 = np.array([0.25, 0.5]) / 0.85
    assert abs(got["c"].kl_variant - (p * np.log(p / q3)).sum()) < 1e-9
    assert got["d"].kl_base is None and got["d"].missing == 1
    far = {r.label: r.distance for r in D.wasserstein(df, "ds", "base", "label", "code", "p").collect()}
    assert far["c"] == 0.0 and far["d"] == 0.25


def test_absent_codes_complete_the_grid(spark):
    _, df = dense_table(spark, 10, 8, 2)
    absent = B.absent_codes(df, "label", "code", df.select("code"))
    assert absent.count() + df.count() == 10 * df.select("code").distinct().count()
    assert absent.join(df, ["label", "code"]).count() == 0


def test_class_rates_with_empty_rows(spark):
    df = spark.createDataFrame([("a", ["x"]), ("a", []), ("a", ["x", "x"]), ("b", [])], "label string, codes array<string>")
    got = [(r.label, r.code, r.hits, r.n) for r in B.class_rates(df, "label", "codes").collect()]
    assert got == [("a", "x", 2, 3)]


def test_resample_keeps_sizes(spark):
    weights = spark.createDataFrame([("a", f"c{i}", 1.0 + i) for i in range(8)] + [("b", "c0", 1.0), ("b", "c1", 1.0)], "label string, code string, weight double")
    rows = spark.createDataFrame([(i, "a", [f"c{j}" for j in range(i % 8)]) for i in range(300)] + [(900, "b", ["c0", "c1"])], "id long, label string, codes array<string>")
    out = V.resample(rows, weights, "id", "label", "codes", 1).toPandas()
    assert len(out) == 301
    for r in out.itertuples():
        size = 2 if r.id == 900 else r.id % 8
        assert len(r.codes) == size == len(set(r.codes))
    drawn = pd.Series([c for r in out.itertuples() for c in r.codes if r.label == "a"]).value_counts()
    assert drawn["c7"] > drawn["c0"]


def test_perturb_bounds(spark):
    defs = spark.createDataFrame([("k", f"c{i}", float(p)) for i, p in enumerate([0.5, 1, 50, 99, 100])], "condition string, code string, probability double")
    got = {r.code: r.probability for r in V.perturb(defs, 30, 1).collect()}
    assert got["c0"] == 5.0 and got["c2"] in (35.0, 65.0)
    assert all(1 < p < 100 for p in got.values())


def test_multiset_difference(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "l string, n int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "l string, n int")
    got = {(r.l, r.n): (r.left, r.right) for r in Q.multiset_difference(a, b, ["l", "n"]).collect()}
    assert got == {("x", 1): (2, 1), ("z", 3): (0, 1)}


def test_fan_out_is_a_left_join(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    facts = spark.createDataFrame([(1, 10), (1, 11), (3, 12), (9, 13)], "pid int, v int")
    got = sorted(R.fan_out(parents, facts, "id", "pid").collect(), key=str)
    assert got == sorted(parents.join(facts, F.col("id") == F.col("pid"), "left").collect(), key=str)
