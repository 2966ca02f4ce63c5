"""Merges, draws and exact distances on small tables."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import distances as D
from anamnesis.operators import pairwise as P
from anamnesis.operators import records as R
from anamnesis.operators import variants as V


def test_merge_of_keyed_inputs(spark):
    """Absent keys on both sides, repeated and NULL keys, NULL values, three inputs."""
    one = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1), (None, "n", 1), ("z", None, 5)], "key string, value string, place int")
    two = spark.createDataFrame([("b", "4", 0), ("c", "5", 9), (None, "m", 0)], "key string, value string, place int")
    three = spark.createDataFrame([("c", "6", 1)], "key string, value string, place int")
    got = {r["key"]: (r["value"], r["place"], r["input"], r["inputs"]) for r in R.merge_keyed([one, two, three], ["key"], "place").collect()}
    assert got == {"a": ("2", 2, 0, 1), "b": ("4", 0, 1, 2), "c": ("6", 1, 2, 2), None: ("m", 0, 1, 2), "z": (None, 5, 0, 1)}
    assert R.merge_keyed([one.where("false"), two.where("false")], ["key"], "place").count() == 0


def drawn(row_id, items, n, seed, weighted):
    def key(item):
        u = (int(hashlib.md5(f"{seed}-{row_id}-{item[0]}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0
        return (-math.log(u) / item[1] if weighted else u), item[0]

    return sorted(c for c, _ in sorted(items, key=key)[:n])


@pytest.mark.parametrize("weighted", [True, False])
def test_draw_by_hand(spark, weighted):
    lists = {"x": [(f"c{i:02}", float(i % 5 + 1)) for i in range(30)], "y": [("only", 2.0)], "é": [("ä", 1.0), ("b", 3.0)]}
    records = [(i, ["x", "y", "é", "none", None][i % 5], [f"o{j}" for j in range(i % 7)]) for i in range(200)] + [(200, "x", [str(j) for j in range(40)]), (None, "x", ["a", "b"])]
    weights = spark.createDataFrame([(k, c, w) for k, v in lists.items() for c, w in v], "label string, code string, weight double")
    rows = spark.createDataFrame(records, "id long, label string, codes array<string>")
    got = {r["id"]: r["codes"] for r in V.resample(rows, weights, "id", "label", "codes", 9, weighted).collect()}
    assert len(got) == 202
    for i, label, codes in records:
        if i is not None:
            assert got[i] == (drawn(i, lists[label], len(codes), 9, weighted) if codes and label in lists else codes)


def test_variability_is_exact(spark):
    """A tie at the seventh digit is rounded up, whatever the order of rows."""
    # (64 - 2 x ...) chosen so that the index is 4121 / 16000 = 0.2575625 in whole numbers.
    rows = [("a", "c1", 641, 1000), ("a", "c2", 0, 1000), ("b", "c1", 0, 16), ("b", "c2", 0, 16)]
    hits = spark.createDataFrame(rows, "label string, code string, hits long, n long")
    for width, want in ((1, 0.641), (16, 0.040063), (10**6, 1e-06)):
        got = D.variability(hits, "label", "code", F.lit(width)).collect()
        assert [(r["a"], r["b"], r["variability"]) for r in got] == [("a", "b", want)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variability_by_hand(spark, seed):
    import random
    from fractions import Fraction

    rnd = random.Random(seed)
    sizes = {c: rnd.randint(1, 70) for c in "abcd"}
    rows = [(c, f"w{i}", rnd.randint(0, sizes[c]), sizes[c]) for c in sizes for i in range(12)]
    hits = spark.createDataFrame(rows, "label string, code string, hits long, n long")
    p = {(c, w): Fraction(k, n) for c, w, k, n in rows}
    for r in D.variability(hits, "label", "code", F.lit(12)).collect():
        exact = sum(p[r["a"], f"w{i}"] * (1 - p[r["b"], f"w{i}"]) + p[r["b"], f"w{i}"] * (1 - p[r["a"], f"w{i}"]) for i in range(12)) / 12
        assert r["variability"] == float(math.floor(exact * 10**6 + Fraction(1, 2))) / 1e6


@pytest.mark.parametrize("blocks", [(256, 4096), (3, 4), (1, 1)])
def test_cross_products(spark, blocks):
    """Against plain sums, for any cut into blocks; rows without a common column have no pair."""
    import random

    rnd = random.Random(3)
    one = {(i, f"c{j}"): float(rnd.randint(1, 9)) for i in range(20) for j in range(15) if rnd.random() < 0.3}
    two = {(f"r{i}", f"c{j}"): float(rnd.randint(-3, 9)) for i in range(8) for j in range(18) if rnd.random() < 0.3}
    left, right = (spark.createDataFrame([(*k, v) for k, v in d.items()], f"row {t}, col string, v double") for d, t in ((one, "long"), (two, "string")))
    got = {(r["a"], r["b"]): r["dot"] for r in P.cross_products(left, right, "row", "col", "v", *blocks).collect()}
    want = {}
    for (a, c), v in one.items():
        for (b, d), w in two.items():
            if c == d and w:
                want[a, b] = want.get((a, b), 0) + v * w
    assert got == want
    assert P.cross_products(left.where("false"), right, "row", "col", "v").count() == 0
