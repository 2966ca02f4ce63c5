"""Queries that SQL cannot say, against plain Python: hashed keys, forests walked node by node, networks layer by layer, components."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.operators import ensembles as E
from anamnesis.plans import catalog, models
from anamnesis.plans.registry import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SMALL)


def run(spark, name):
    return catalog.QUERIES[name](spark, SMALL).collect()


def sha224(text):
    return hashlib.sha224(text.encode()).hexdigest()


def test_hashed_keys(spark, tables):
    parts = tables.part.collect()
    assert {(r["p_name"], r["key"]) for r in run(spark, "h7_sha224_keys")} == {(r["p_name"], sha224(r["p_name"])) for r in parts}
    most = defaultdict(int)
    for r in parts:
        key = sha224(r["p_type"]), sha224(r["p_name"])
        most[key] = max(most[key], r["p_size"])
    assert {(r["condition"], r["symptom"]): r["probability"] for r in run(spark, "j17_hashed_probabilities")} == most


def test_sparse_text(spark):
    """The text holds the codes of the twinned query under hashed names."""
    want = defaultdict(set)
    for r in run(spark, "j11_attribute_records"):
        want[r["row_id"]].add(f"{sha224(r['symptom'])}|{r['code']}")
    got = {r["row_id"]: r["SYMPTOMS"].split(";") for r in run(spark, "j11_sparse_text")}
    assert got.keys() == want.keys()
    for k, items in got.items():
        assert len(items) == len(set(items)) and set(items) == want[k]


def dense(tables):
    rows = tables.embeddings.orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64), [r["label"] for r in rows]


def nodes_of(spark, model, path):
    model.write().save(path)
    trees = defaultdict(dict)
    for r in spark.read.parquet(f"{path}/data").collect():
        n = r["nodeData"]
        trees[r["treeID"]][n["id"]] = n
    return [trees[i] for i in sorted(trees)]


def leaf(tree, x):
    node = tree[0]
    while node["leftChild"] >= 0:
        split = node["split"]
        node = tree[node["leftChild"] if x[split["featureIndex"]] <= split["leftCategoriesOrThreshold"][0] else node["rightChild"]]
    return node


def forest_probabilities(trees, x):
    total = 0
    for tree in trees:
        stats = np.array(leaf(tree, x)["impurityStats"])
        total = total + stats / stats.sum()
    return total / len(trees)


def test_forest(spark, tables, tmp_path):
    ids, x, _ = dense(tables)
    model = E.random_forest(trees=20, depth=8, seed=1).fit(models.vectors(tables))
    trees = nodes_of(spark, model, str(tmp_path / "forest"))
    assert len(trees) == 20
    got = {r["vec_id"]: r["pred"] for r in run(spark, "m9_random_forest")}
    assert got == {i: int(np.argmax(forest_probabilities(trees, v))) for i, v in zip(ids, x)}


def test_forest_by_chunk(spark, tables, tmp_path):
    ids, x, _ = dense(tables)
    first = [hashlib.md5(str(i).encode()).hexdigest()[0] < "8" for i in ids]
    grown = []
    for k in (0, 1):
        own = [i for i, f in zip(ids, first) if f == (k == 0)]
        assert 100 < len(own) < 400
        rows = models.vectors(tables).where(F.col("vec_id").isin(own))
        grown.append(nodes_of(spark, E.random_forest(trees=10, depth=6, seed=k).fit(rows), str(tmp_path / f"chunk{k}")))
    got = {r["vec_id"]: r["pred"] for r in run(spark, "m10_forest_by_chunk")}
    want = {i: int(np.argmax(sum(forest_probabilities(trees, v) for trees in grown))) for i, v in zip(ids, x)}
    assert got == want


def test_boosting(spark, tables, tmp_path):
    ids, x, labels = dense(tables)
    stages = E.boosted(rounds=2, depth=3, seed=1).fit(models.vectors(tables)).models
    assert len(stages) == len(set(labels))
    margins = []
    for k, stage in enumerate(stages):
        trees = nodes_of(spark, stage, str(tmp_path / f"stage{k}"))
        margins.append([sum(w * leaf(t, v)["prediction"] for w, t in zip(stage.treeWeights, trees)) for v in x])
    best = np.argmax(np.array(margins), axis=0)
    assert {r["vec_id"]: r["pred"] for r in run(spark, "m11_gradient_boosting")} == dict(zip(ids, best.tolist()))


def test_perceptron(spark, tables):
    ids, x, _ = dense(tables)
    layers = [64, 32, 10]
    model = E.perceptron(layers, rounds=20, seed=1).fit(models.vectors(tables))
    weights, at, out = model.weights.toArray(), 0, x
    for i, (a, b) in enumerate(zip(layers, layers[1:])):
        w = weights[at : at + a * b].reshape(a, b).T  # stored by columns
        bias = weights[at + a * b : at + a * b + b]
        at += a * b + b
        out = out @ w.T + bias
        if i < len(layers) - 2:
            out = 1 / (1 + np.exp(-out))
    assert at == len(weights)
    got = {r["vec_id"]: r["pred"] for r in run(spark, "m12_perceptron")}
    assert sum(got[i] == p for i, p in zip(ids, np.argmax(out, axis=1).tolist())) >= 0.99 * len(ids)


def test_importances(spark, tables, tmp_path):
    """Gains of the splits of each tree, weighted by rows, as shares; their mean over the trees as shares again."""
    rows, names = models.record_vectors(tables)
    trees = nodes_of(spark, E.random_forest(trees=10, depth=6, seed=1).fit(rows), str(tmp_path / "forest"))
    total = np.zeros(len(names))
    for tree in trees:
        own = np.zeros(len(names))
        for n in tree.values():
            if n["leftChild"] >= 0:
                own[n["split"]["featureIndex"]] += n["gain"] * sum(n["impurityStats"])
        total += own / own.sum()
    total /= total.sum()
    got = {r["feature"]: (r["importance"], r["rank"]) for r in run(spark, "m14_feature_importance")}
    assert got.keys() == set(names) and sorted(r for _, r in got.values()) == list(range(1, len(names) + 1))
    assert np.allclose([got[n][0] for n in names], total, atol=0.02)
    assert [v for v, _ in sorted(got.values(), key=lambda x: x[1])] == sorted((v for v, _ in got.values()), reverse=True)


def test_grid(spark):
    got = run(spark, "m15_grid_search")
    assert {r["name"] for r in got} == {f"numTrees_{n} maxDepth_{d}" for n in (5, 10) for d in (3, 6)}
    assert all(0 <= r["accuracy"] <= 1 for r in got)


def test_components(spark, tables):
    ids, x, _ = dense(tables)
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = x @ axes[:3].T
    got = {r["vec_id"]: [r["z0"], r["z1"], r["z2"]] for r in run(spark, "l10_latent_components")}
    own = np.array([got[i] for i in ids])
    for k in range(3):
        sign = np.sign(own[:, k] @ want[:, k])
        assert np.allclose(own[:, k], sign * want[:, k], atol=2e-6)
