"""Naive Bayes: dense against joined scores, against pyspark.ml, merge, store, keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizerModel, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from anamnesis.operators import bayes as N
from anamnesis.operators import curves as U
from anamnesis.operators import estimators as M
from anamnesis.operators.scoring import score_batch, top_columns

WORDS = [f"w{i}" for i in range(12)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(1200):
        label = "hot" if rng.random() < 0.4 else f"c{rng.integers(0, 6)}"
        base = 0.1 + 0.08 * (sum(map(ord, label)) % 5)
        tokens = [w for j, w in enumerate(WORDS) if rng.random() < (base if j % 3 else 0.3)]
        data.append((i, label, tokens + (["unknown"] if rng.random() < 0.05 else []), None if rng.random() < 0.03 else float(rng.integers(0, 90))))
    return spark.createDataFrame(data, "id long, label string, tokens array<string>, age double").cache()


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "token string")


def tops(df):
    return {r.id: ([(t.label, round(t.p, 9)) for t in r.top], round(r.own, 9)) for r in df.select("id", "top", "own").collect()}


def exact(df):
    """Rows with their answers, in the order of their text; no rounding."""
    return sorted(repr((r.id, [(t.label, t.p) for t in r.top], r.own)) for r in df.select("id", "top", "own").collect())


def by_hand(rows, words, spec, label_of_own="label"):
    """All classes of all rows in plain Python: {id: ({label: p}, own)}."""
    data = [r.asDict() for r in rows.collect()]
    known = {r.token for r in words.collect()}
    classes = sorted({r["label"] for r in data})
    n = {c: sum(r["label"] == c for r in data) for c in classes}
    ages = {c: [r["age"] for r in data if r["label"] == c and r["age"] is not None] for c in classes}
    every = [a for c in classes for a in ages[c]]
    out = {}
    for r in data:
        s = {}
        for c in classes:
            times = {"per_component": spec.components, "once": 1, "uniform": 0}[spec.prior]
            s[c] = times * np.log(n[c] / len(data))
            for w in known:
                k = hits(data, c, w)
                p = (k + 1) / (n[c] + 2) if spec.smoothing == "laplace" else min(1 - spec.eps, max(spec.eps, k / n[c]))
                s[c] += np.log(p if w in r["tokens"] else 1 - p)
            if r["age"] is not None:
                var = np.var(ages[c]) + 1e-9 * np.var(every)
                s[c] += -0.5 * np.log(2 * np.pi * var) - (r["age"] - np.mean(ages[c])) ** 2 / (2 * var)
        top = max(s.values())
        whole = sum(np.exp(v - top) for v in s.values())
        out[r["id"]] = {c: np.exp(v - top) / whole for c, v in s.items()}
    return out


_HITS = {}


def hits(data, label, word):
    if (label, word) not in _HITS:
        _HITS[label, word] = sum(r["label"] == label and word in r["tokens"] for r in data)
    return _HITS[label, word]


@pytest.mark.parametrize("spec", [N.BayesSpec(), N.BayesSpec("clamp", prior="uniform"), N.BayesSpec(prior="once")])
def test_scores_by_hand(rows, words, spec):
    model = N.fit(rows, "label", "tokens", words, ["age"], spec)
    want = by_hand(rows, words, spec)
    got = {r.id: r for r in model.score(rows, "tokens", 3, "label").collect()}
    logs = {r.id: {x.label: x.log_p for x in r.log_p} for r in model.log_probabilities(rows, "tokens").collect()}
    assert got.keys() == want.keys()
    for k, p in want.items():
        assert [t.label for t in got[k].top] == sorted(p, key=lambda c: (-round(p[c], 12), c))[:3]
        assert np.allclose([t.p for t in got[k].top], [p[t.label] for t in got[k].top], atol=1e-9) and abs(got[k].own - p[got[k].label]) < 1e-9
        assert list(logs[k]) == sorted(p) and np.allclose([np.exp(logs[k][c]) for c in p], list(p.values()), atol=1e-9)


@pytest.mark.parametrize("cells", [1, 30, 1_000_000])
def test_blocks_change_no_bit(rows, words, monkeypatch, cells):
    """One class a block, a few, all: the same bits, and the same as by default."""
    fit = lambda: N.fit(rows, "label", "tokens", words, ["age"])
    want, logs = exact(fit().score(rows, "tokens", 3, "label")), [r.log_p for r in fit().log_probabilities(rows, "tokens").orderBy("id").collect()]
    monkeypatch.setattr(N, "BLOCK_CELLS", cells)
    model = fit()
    assert exact(model.score(rows, "tokens", 3, "label")) == want
    assert len(model._sent) == {1: 7, 30: 4, 1_000_000: 1}[cells]
    assert [r.log_p for r in model.log_probabilities(rows, "tokens").orderBy("id").collect()] == logs


def test_against_library(rows, words):
    """Bernoulli part alone against the one of pyspark.ml."""
    known = rows.withColumn("tokens", F.array_intersect("tokens", F.array(*[F.lit(w) for w in WORDS])))
    vec = CountVectorizerModel.from_vocabulary(WORDS, inputCol="tokens", outputCol="features").setBinary(True).transform(known)
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(vec)
    data = indexer.transform(vec)
    lib = NaiveBayes(modelType="bernoulli", smoothing=1.0, labelCol="y").fit(data).transform(data)
    want = {r.id: r.p for r in lib.select("id", vector_to_array("probability").alias("p")).collect()}
    model = N.fit(rows, "label", "tokens", words, spec=N.BayesSpec(components=1))
    labels = indexer.labels
    # The library smooths the class prior as well; take that out.
    n = np.array([data.where(F.col("label") == c).count() for c in labels], float)
    factor = (n / n.sum()) / ((n + 1) / (n.sum() + len(n)))
    want = {i: np.array(p) * factor / (np.array(p) @ factor) for i, p in want.items()}
    for i, (top, _) in tops(model.score(rows, "tokens", len(labels), "label")).items():
        got = dict(top)
        assert np.allclose([got[c] for c in labels], want[i], atol=1e-6)
        assert abs(sum(got.values()) - 1) < 1e-6


def test_gaussian_by_hand(rows):
    model = N.fit_gaussian(rows, "label", ["age"])
    pdf = rows.select("id", "label", "age").toPandas().dropna()
    stats = pdf.groupby("label").age.agg(["mean", lambda s: s.var(ddof=0)])
    stats.columns = ["m", "v"]
    stats["v"] += 1e-9 * pdf.age.var(ddof=0)
    x = pdf.age.iloc[0]
    logp = -0.5 * np.log(2 * np.pi * stats.v) - (x - stats.m) ** 2 / (2 * stats.v)
    p = np.exp(logp - logp.max())
    p /= p.sum()
    got = dict(tops(model.score(rows, "tokens", 10, "label"))[pdf.id.iloc[0]][0])
    # The smoothing uses rows of all classes; ages missing do not count.
    for c in p.index:
        assert abs(got[c] - p[c]) < 1e-6


def test_merged_batches_equal_one(rows, words):
    parts = [N.statistics(rows.where(F.col("id") % 3 == i), "label", "tokens", ["age"]) for i in range(3)]
    merged = N.fit_counts(N.merge_counts([c for c, _ in parts]), N.merge_moments([s for _, s in parts]), words, ["age"])
    whole = N.fit(rows, "label", "tokens", words, ["age"])
    a, b = tops(merged.score(rows, "tokens", 2, "label")), tops(whole.score(rows, "tokens", 2, "label"))
    assert all(np.allclose([x[1] for x in a[k][0]], [x[1] for x in b[k][0]], atol=1e-7) for k in a)


def test_store_and_load(rows, words, spark, tmp_path):
    model = N.fit(rows, "label", "tokens", words, ["age"])
    model.save(str(tmp_path / "m"))
    again = N.BayesModel.load(spark, str(tmp_path / "m"))
    assert tops(model.score(rows, "tokens", 2, "label")) == tops(again.score(rows, "tokens", 2, "label"))


def test_keyed_models_score_their_own_rows(rows, words):
    tagged = rows.withColumn("fold", (F.col("id") % 2).cast("int"))
    keyed = N.fit(tagged, "label", "tokens", words, ["age"], keys=["fold"])
    got = tops(keyed.score(tagged, "tokens", 2, "label"))
    for f in (0, 1):
        part = tagged.where(F.col("fold") == f)
        want = tops(N.fit(part, "label", "tokens", words, ["age"]).score(part, "tokens", 2, "label"))
        for k in want:
            assert np.allclose([x[1] for x in got[k][0]], [x[1] for x in want[k][0]], atol=1e-8)


def test_categorical_sums_to_one(spark):
    data = [(i, "a" if i % 3 else "b", [f"s1|{i % 4}"] + ([f"s2|{i % 2}"] if i % 5 else [])) for i in range(200)]
    rows = spark.createDataFrame(data, "id long, label string, tokens array<string>")
    got = N.fit_categorical(rows, "label", "tokens").score(rows, "tokens", 2, "label").select("top").collect()
    assert all(abs(sum(t.p for t in r.top) - 1) < 1e-9 for r in got)


def test_rule_table(spark):
    rows = spark.createDataFrame([("x", ["b", "a"]), ("x", ["a", "b"]), ("y", ["a", "b"]), ("z", ["c"]), ("y", ["c"])], "label string, codes array<string>")
    got = {r.mask: (r.rule, r.n) for r in N.rule_table(rows, "label", "codes").collect()}
    assert got == {"a;b": ("x", 3), "c": ("y", 2)}


def test_ties_at_the_cut_are_broken_by_label():
    scores = np.array([[1.0, 3.0, 3.0, 3.0], [4.0, 4.0, 4.0, 4.0], [0.0, 1.0, 2.0, 3.0]])
    assert top_columns(scores, 2).tolist() == [[1, 2], [0, 1], [3, 2]]


def test_estimator_and_evaluator(rows, words):
    model = M.CompositeNaiveBayes(labelCol="label", numberCols=["age"]).setDictionary(words).fit(rows)
    out = model.transform(rows)
    scores = [M.TopNEvaluator(n=n).evaluate(out) for n in (1, 3, 7)]
    assert scores == sorted(scores) or scores[0] <= scores[1] <= scores[2]


def test_learning_curve_counts(rows, words):
    curve = U.learning_curve(rows, "label", "tokens", ["id"], words, ["age"], [0.5, 1.0], 3, N.BayesSpec()).toPandas()
    held = curve[curve.role == "test"]
    assert len(curve) == 12 and (held.groupby("level").n.sum() == 1200).all()
    assert curve.top_1.between(0, 1).all() and (curve.top_5 >= curve.top_1).all()
    assert isinstance(curve, pd.DataFrame)


AWKWARD = [
    (1, "a", ["w0", "w1"], 1.0), (1, "a", ["w0"], 3.0), (1, "b", ["w1", "w1"], 2.0), (None, "b", ["w2"], 5.0), (None, "a", None, 4.0), (2, None, ["w2", "w0"], 7.0),
    (3, None, ["w2"], 9.0), (4, "none", ["w1", "w2"], None), (4, "none", ["w0", None, "unknown"], None), (5, "a", [], float("nan")), (5, "b", ["w1"], 2.0),
]


@pytest.mark.parametrize("keys", [[], ["fold"]])
def test_awkward_rows_in_blocks(spark, words, monkeypatch, keys):
    """NULL and repeated ids, a NULL class, a class without numbers, a NaN, NULL tokens: every row is answered, alike for all blocks."""
    data = [(*r, at, f) for f in (0, None) for at, r in enumerate(AWKWARD)]
    rows = spark.createDataFrame(data, "id long, label string, tokens array<string>, age double, at int, fold int")
    fitted = rows.where("not isnan(age) or age is null")

    def answers(label):
        model = N.fit(fitted, "label", "tokens", words, ["age"], keys=keys)
        scored = model.score(rows, "tokens", 3, label)
        assert scored.columns == [*rows.columns, "top", "own"]
        return {(r["at"], r["fold"]): (r["id"], [(x["label"], x["p"]) for x in r["top"]], r["own"]) for r in scored.collect()}

    want = answers("label"), answers(None)
    assert len(want[0]) == len(data) and all(own is not None for _, _, own in want[0].values())
    monkeypatch.setattr(N, "BLOCK_CELLS", 1)
    assert (answers("label"), answers(None)) == want


def test_unknown_key_is_an_error(rows, words):
    tagged = rows.withColumn("fold", (F.col("id") % 2).cast("int"))
    keyed = N.fit(tagged.where("fold = 0"), "label", "tokens", words, ["age"], keys=["fold"])
    with pytest.raises(Exception, match="no model has the key"):
        keyed.score(tagged, "tokens").collect()


def test_far_apart_scores(monkeypatch):
    """Sums over hundreds of powers of ten, in any order of blocks, without overflow or loss."""
    import pyarrow as pa

    class Sent:
        def __init__(self, value):
            self.__dict__["_file"] = value

        def __getattr__(self, name):
            self.__dict__["_value"] = self._file
            return self._file

    base = np.array([-4000.0, 0.0, 900.0, 899.0, -np.inf, 5.0])
    none = pa.array(["w"])

    def block(a, b):
        return {"": {"labels": [f"c{i}" for i in range(a, b)], "words": none, "base": base[a:b], "matrix": np.zeros((1, b - a)), "mean": np.zeros((0, b - a)), "var": np.ones((0, b - a))}}

    args = [pa.array([""]), pa.array([[]], pa.list_(pa.string())), pa.array([[]], pa.list_(pa.float64())), pa.array(["c3"])]
    answers = [score_batch([Sent(block(a, b)) for a, b in cuts], *args, 3).to_pylist() for cuts in ([(0, 6)], [(i, i + 1) for i in range(6)], [(0, 2), (2, 6)])]
    assert answers[0] == answers[1] == answers[2]
    assert [x["label"] for x in answers[0][0]["top"]] == ["c2", "c3", "c5"]
    assert abs(answers[0][0]["own"] - 1 / (1 + np.e)) < 1e-15


@pytest.mark.parametrize("name", ["m6_composite_top5", "n14_learning_curve"])
def test_queries_score_in_blocks(spark, monkeypatch, name):
    from anamnesis.plans import catalog

    run = lambda: sorted(map(repr, map(tuple, catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect())))
    want = run()
    monkeypatch.setattr(N, "BLOCK_CELLS", 1)
    assert run() == want


def test_estimator_in_blocks(rows, words, monkeypatch):
    fit = lambda: M.CompositeNaiveBayes(labelCol="label", numberCols=["age"]).setDictionary(words).fit(rows)
    want = {r["id"]: r["prediction"] for r in fit().transform(rows).collect()}
    monkeypatch.setattr(N, "BLOCK_CELLS", 1)
    assert {r["id"]: r["prediction"] for r in fit().transform(rows).collect()} == want


@pytest.fixture(scope="module")
def with_race(rows):
    race = F.concat(F.lit("race_"), (F.col("id") % 7 % 4).cast("string"))
    return rows.withColumn("tokens", F.when(F.col("id") % 11 == 0, F.col("tokens")).otherwise(F.array_append("tokens", race)))


def parts_of(rows, words, spark):
    counts, stats = N.statistics(rows, "label", "tokens", ["age"])
    one = N.BayesSpec(components=1)
    race = spark.createDataFrame([(f"race_{i}",) for i in range(5)], "token string")
    first, rest = words.where("token < 'w3'"), words.where("token >= 'w3'")
    return [N.fit_counts(counts, None, first, spec=one), N.fit_multinomial(counts, race, one), N.fit_counts(counts, stats, words.where("false"), ["age"], one), N.fit_counts(counts, None, rest, spec=one)]


def log_rows(model, rows):
    return {r["id"]: {x["label"]: x["log_p"] for x in r["log_p"]} for r in model.log_probabilities(rows, "tokens").collect()}


@pytest.mark.parametrize("cells", [1, 10**6])
def test_composition_is_the_sum_of_its_parts(with_race, words, spark, monkeypatch, cells):
    monkeypatch.setattr(N, "BLOCK_CELLS", cells)
    parts = parts_of(with_race, words, spark)
    whole = log_rows(N.compose(*parts), with_race)
    alone = [log_rows(p, with_race) for p in parts]
    assert len(whole) == 1200
    for k, got in whole.items():
        s = {c: sum(a[k][c] for a in alone) for c in got}
        z = np.logaddexp.reduce(list(s.values()))
        assert np.allclose(list(got.values()), [v - z for v in s.values()], atol=1e-9)


def test_race_changes_every_class(with_race, words, spark):
    model = N.compose(*parts_of(with_race, words, spark))
    one = with_race.where("id = 3")
    moved = one.withColumn("tokens", F.transform("tokens", lambda x: F.when(x.startswith("race_"), "race_0").otherwise(x)))
    a, b = log_rows(model, one)[3], log_rows(model, moved)[3]
    assert a.keys() == b.keys() and all(abs(a[c] - b[c]) > 1e-6 for c in a)


def test_multinomial_part_by_hand(with_race, words, spark):
    """Smoothed shares of the races among the class's rows that have one, an unseen race (race_4) too."""
    model = parts_of(with_race, words, spark)[1]
    data = [r.asDict() for r in with_race.collect()]
    seen = [(r["label"], t) for r in data for t in r["tokens"] if t.startswith("race_")]
    for k, got in list(log_rows(model, with_race).items())[:200]:
        row = next(r for r in data if r["id"] == k)
        race = [t for t in row["tokens"] if t.startswith("race_")]
        s = {}
        for c in got:
            s[c] = np.log(sum(r["label"] == c for r in data) / len(data))
            if race:
                s[c] += np.log((sum(x == (c, race[0]) for x in seen) + 1) / (sum(x[0] == c for x in seen) + 5))
        z = np.logaddexp.reduce(list(s.values()))
        assert all(abs(got[c] - s[c] + z) < 1e-9 for c in got)


def test_parts_that_cannot_be_composed(with_race, words, spark):
    parts = parts_of(with_race, words, spark)
    with pytest.raises(ValueError, match="tokens of their own"):
        N.compose(parts[0], parts[0])
    with pytest.raises(ValueError, match="numbers of their own"):
        N.compose(parts[2], parts[2])


def test_composed_model_store(with_race, words, spark, tmp_path):
    model = N.compose(*parts_of(with_race, words, spark))
    model.save(str(tmp_path / "m"))
    assert log_rows(N.BayesModel.load(spark, str(tmp_path / "m")), with_race) == log_rows(model, with_race)


def test_pipeline_goes_through_files(rows, words, spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    stage = M.CompositeNaiveBayes(labelCol="label", numberCols=["age"], top=3, alpha=2.0).setDictionary(words)
    Pipeline(stages=[stage]).write().save(str(tmp_path / "raw"))
    fitted = Pipeline.load(str(tmp_path / "raw")).fit(rows)
    fitted.write().save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    want = exact(Pipeline(stages=[stage]).fit(rows).transform(rows))
    assert exact(fitted.transform(rows)) == want and exact(again.transform(rows)) == want
    assert again.stages[0].uid == fitted.stages[0].uid and again.stages[0].getOrDefault("top") == 3
    with pytest.raises(Exception, match="already exists"):
        fitted.write().save(str(tmp_path / "fitted"))


def test_kept_fold_model(rows, words, spark):
    run = U.cross_validation(rows, "label", "tokens", ["id"], words, ["age"], 3, N.BayesSpec())
    scores = {r["fold"]: r["top_1"] for r in run.fold_scores((1,)).collect()}
    fold, model = run.keep_best()
    assert scores[fold] == max(scores.values()) and model.keys == ()
    held = run.rows.where(F.col("fold") == fold)
    assert exact(model.score(held, "tokens", 5, "label")) == exact(run.scored().where(F.col("fold") == fold))


def test_kept_fold_model_under_another_plan(rows, words, spark):
    run = U.cross_validation(rows, "label", "tokens", ["id"], words, ["age"], 3, N.BayesSpec())
    scored = run.scored()
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        fold, model = run.keep_best()
        held = run.rows.where(F.col("fold") == fold)
        assert exact(model.score(held, "tokens", 5, "label")) == exact(scored.where(F.col("fold") == fold))
    finally:
        spark.conf.set(name, before)


def test_curve_roles_and_times(rows, words):
    options = ["label", "tokens", ["id"], words, ["age"], [0.5, 1.0], 3, N.BayesSpec()]
    cells = {(r["level"], r["fold"], r["role"]): r for r in U.learning_curve(rows, *options).collect()}
    assert len(cells) == 12
    for fold in range(3):
        assert cells[1, fold, "test"]["n"] + cells[1, fold, "train"]["n"] == 1200
        assert cells[0, fold, "test"]["n"] == cells[1, fold, "test"]["n"] and cells[0, fold, "train"]["n"] < cells[1, fold, "train"]["n"]
    times = U.curve_times(rows, *options).collect()
    assert len(times) == 6 and all(r["fit_seconds"] > 0 and r["score_seconds"] > 0 for r in times)
    assert all(r["train_n"] == cells[r["level"], r["fold"], "train"]["n"] and r["test_n"] == cells[r["level"], r["fold"], "test"]["n"] for r in times)
