from anamnesis.llm import toxicity as tox
from tests.llm.common import frame, given


def test_held_out(spark, sf_dir):
    """Fitted on the labels of even ids, judged on the others."""
    df, rows = given(spark, sf_dir.replace("0.01", "0.1"))
    labels, _ = given(spark, sf_dir.replace("0.01", "0.1"), "labels")
    chain = tox.fit_chain(df, labels.where("doc_id % 2 = 0"))
    listed = {w for _, words in tox.CATEGORIES for w in words}
    marked = {r["doc_id"]: len(listed & set(tox._WORD.findall((r["text"] or "").lower()))) for r in rows}
    said = {r["doc_id"]: r["toxic"] for r in tox.toxicity(df, chain).where("doc_id % 2 = 1").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] % 2}
    clean, toxic = ([d for d in truth if truth[d] == k and d in said] for k in (0, 1))
    rude = [d for d in said if marked[d] >= 2]
    assert len(rude) > 100 and sum(said[d] for d in rude) / len(rude) > 0.97
    assert sum(said[d] for d in toxic) / len(toxic) > 0.8
    assert sum(said[d] for d in clean) / len(clean) < 0.01


def test_chain_uses_earlier_categories(spark):
    rows = [(i, ("you idiot scum " if i % 2 else "kind good words ") + f"w{i % 7}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    chain = tox.fit_chain(frame(spark, rows), labels)
    assert chain.names == ["insult", "contempt", "toxic"]
    assert [len(m.earlier) for m in chain.models] == [0, 1, 2] and chain.models[2].earlier.any()
    got = {r["doc_id"]: r for r in tox.toxicity(frame(spark, rows), chain).collect()}
    assert all(got[i]["toxic"] == i % 2 for i in range(60))
    kept = tox.without_toxic(frame(spark, rows), chain)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 60, 2))


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "idiot"), (4, "…!?"), (5, "word " * 200_000)]
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    got = tox.toxicity(frame(spark, rows), tox.fit_chain(frame(spark, rows), labels)).collect()
    assert len(got) == 6 and all(r["toxic"] in (0, 1) and 0 <= r["p_toxic"] <= 1 for r in got)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    some = frame(spark, [(1, "idiot")])
    chain = tox.fit_chain(some, labels)
    assert [r["toxic"] for r in tox.toxicity(some, chain).collect()] == [0]
    assert tox.toxicity(frame(spark, []), tox.fit_chain(frame(spark, []), labels)).collect() == []


def newton(x, y, strength):
    """Penalised logistic regression to its end, with an unpenalised constant in the last column."""
    import numpy as np

    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], strength)
    penalty[-1] = 0
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) / len(y) + penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(penalty + 1e-12)
        step = np.linalg.solve(bend, slope)
        rate = 1.0

        def loss(v):
            s = x @ v
            return np.mean(np.logaddexp(0, s) - y * s) + strength / 2 * (v[:-1] @ v[:-1])

        while loss(w - rate * step) > loss(w) and rate > 1e-8:
            rate /= 2
        w = w - rate * step
        if np.abs(step).max() < 1e-10:
            break
    return w


def test_chain_by_hand():
    """Folds, out-of-fold columns and the full refit, with dense matrices and another optimiser: the same probabilities."""
    import numpy as np

    rnd = np.random.default_rng(5)
    n, vocabulary = 240, 30
    truth = rnd.random((n, 3)) < [[0.3, 0.4, 0.5]]
    truth[:, 2] |= truth[:, 0] & (rnd.random(n) < 0.8)
    labels = truth.astype(float)
    share = np.where(np.arange(vocabulary) < 15, 0.6, 0.1)
    there = np.stack([rnd.random(n) < np.where(truth[:, j % 3], share[j], 0.15) for j in range(vocabulary)], 1)
    rows = [np.flatnonzero(r) for r in there]
    chain = tox.train(rows, labels, ["a", "b", "c"])

    def fitted(part, earlier, label):
        frequency = part.sum(0)
        expected = frequency * label.mean()
        spread = np.sqrt(expected * (1 - frequency / len(label)) + 1e-9)
        hits = (part * label[:, None]).sum(0)
        used = (frequency >= tox.LEAST_DOCUMENTS) & (np.abs(hits - expected) >= tox.LEAST_DEVIATION * spread)
        w = newton(np.column_stack([part[:, used], earlier, np.ones(len(label))]).astype(float), label, tox.STRENGTH)
        return lambda some, before: 1 / (1 + np.exp(-np.column_stack([some[:, used], before, np.ones(len(some))]) @ w))

    fold = np.random.default_rng(1).permutation(n) % tox.FOLDS
    held, out = np.zeros((n, 0)), np.zeros((n, 0))
    for j in range(3):
        column = np.zeros(n)
        for k in range(tox.FOLDS):
            inside = fold != k
            column[~inside] = fitted(there[inside], held[inside], labels[inside, j])(there[~inside], held[~inside])
        final = fitted(there, held, labels[:, j])
        out = np.column_stack([out, final(there, out)])
        held = np.column_stack([held, column])
    got = chain.score(rows)
    assert got.shape == (n, 3) and np.abs(got - out).max() < 0.02
    assert np.abs(got - out).mean() < 2e-3
    assert out.std(0).min() > 0.05
