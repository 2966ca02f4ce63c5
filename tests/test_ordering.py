"""Ranks, fills and quantiles, also with a group that holds a third of the rows and with heavy ties."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from anamnesis.operators import ordering as O
from anamnesis.operators import splits as G


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 6000
    label = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 50, n).astype(str))
    value = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(size=n), 3))
    pdf = pd.DataFrame({"id": np.arange(n), "label": label, "value": value})
    return pdf, spark.createDataFrame(pdf)


def md5(seed, i):
    return hashlib.md5(f"{seed}-{i}".encode()).hexdigest()


def test_hash_rank(skewed):
    pdf, df = skewed
    got = O.hash_rank(df, ["label"], 3, ["id"]).toPandas().set_index("id")
    want = pdf.assign(k=[md5(3, i) for i in pdf.id]).sort_values("k")
    want["rn"] = want.groupby("label").cumcount() + 1
    want["n"] = want.groupby("label").id.transform("size")
    want = want.set_index("id").loc[got.index]
    assert (got.rn == want.rn).all() and (got.n == want.n).all()


def test_value_rank_with_ties(skewed):
    pdf, df = skewed
    got = O.value_rank(df, ["label"], "value", ["id"], descending=True).toPandas().set_index("id")
    want = pdf.sort_values(["value", "id"], ascending=[False, True])
    want["rn"] = want.groupby("label").cumcount() + 1
    assert (got.rn == want.set_index("id").loc[got.index].rn).all()


def test_row_index(skewed):
    pdf, df = skewed
    got = O.row_index(df, "id").toPandas()
    assert (got.Index == got.id).all()


def test_forward_fill(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"pos": np.arange(3000), "head": [f"h{i}" if rng.random() < 0.01 and i > 20 else None for i in range(3000)]})
    got = O.forward_fill(spark.createDataFrame(pdf, "pos long, head string"), "pos", ["head"]).toPandas().sort_values("pos")
    want = pdf["head"].ffill()
    assert got.head_filled.fillna("-").tolist() == want.fillna("-").tolist()


def test_exact_quantiles(skewed):
    pdf, df = skewed
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]
    got = O.exact_quantiles(df, ["label"], "value", probs).toPandas()
    assert len(got) == pdf.label.nunique() * len(probs)
    for r in got.itertuples():
        want = np.quantile(pdf[pdf.label == r.label].value, r.prob)
        assert abs(r.value - want) < 1e-9


def test_exact_quantiles_of_one_row_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, v double")
    got = {(r.g, r.prob): r.value for r in O.exact_quantiles(df, ["g"], "v", [0, 0.5, 1]).collect()}
    assert got == {("a", 0.0): 1.0, ("a", 0.5): 1.0, ("a", 1.0): 1.0, ("b", 0.0): 2.0, ("b", 0.5): 3.0, ("b", 1.0): 4.0}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(train=st.floats(0.1, 0.9), seed=st.integers(0, 1000))
def test_split_sizes(skewed, train, seed):
    pdf, df = skewed
    got = G.stratified_split(df, "label", ["id"], train, seed).toPandas()
    assert len(got) == len(pdf) and got.id.is_unique
    for label, part in got.groupby("label"):
        assert (part.split == "train").sum() == int(np.floor(len(part) * train + 0.5))


def test_kfold_is_balanced(skewed):
    _, df = skewed
    got = G.kfold(df, "label", ["id"], 5).toPandas()
    sizes = got.groupby(["label", "fold"]).size().unstack(fill_value=0)
    assert ((sizes.max(axis=1) - sizes.min(axis=1)) <= 1).all()


def test_learning_fractions_are_nested(skewed):
    pdf, df = skewed
    got = G.learning_fractions(df, "label", ["id"], [0.1, 0.5, 1.0], 1).toPandas()
    assert got.level.notna().all()
    small = (got[got.label == "hot"].level == 0).sum()
    assert small == round((pdf.label == "hot").sum() * 0.1)


def test_positional_split(skewed):
    pdf, df = skewed
    got = G.positional_split(df, "id", 70, 10).toPandas().sort_values("id").split.tolist()
    a, b = int(len(pdf) * 70 / 100), int(len(pdf) * 10 / 100)
    assert got == ["train"] * a + ["val"] * b + ["test"] * (len(pdf) - a - b)


def test_balanced_classes(skewed):
    pdf, df = skewed
    got = G.balance_classes(df, "label", ["id"]).toPandas()
    keep = int(np.floor(pdf.groupby("label").size().min() * 0.95))
    assert (got[got.split == "train"].groupby("label").size() == keep).all()


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a", float(i)) for i in range(30)], "id long, g string, v double")
    ranked = O.hash_rank(df, ["g"], 0, ["id"]).toPandas()
    assert len(ranked) == 30 and sorted(ranked[ranked.g.isna()].rn) == list(range(1, 11))
    got = {r.g: r.value for r in O.exact_quantiles(df, ["g"], "v", [1.0]).collect()}
    assert got == {None: 27.0, "a": 29.0}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, g string, v double")
    assert O.row_index(df, "id").count() == 0
    assert O.exact_quantiles(df, ["g"], "v", [0.5]).count() == 0
    assert O.forward_fill(df, "id", ["g"]).count() == 0
