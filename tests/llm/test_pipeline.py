"""The stages one after the other, each against a plain version on what its predecessor kept."""

import corpus_pipeline as cp
from anamnesis.llm import queries, toxicity
from tests.llm import test_decontamination, test_pieces, test_secret_scan, test_simhash
from tests.llm.common import given


def test_stages(spark, sf_dir):
    df, rows = given(spark, sf_dir)
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scan", "pieces"]
    stages = dict(cp.STAGES)
    labels, _ = given(spark, sf_dir, "labels")
    scores = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(df, toxicity.fit_chain(df, labels)).collect()}
    calm = stages["toxicity"](spark, df, sf_dir).cache()
    assert calm.columns == df.columns and sorted(r["doc_id"] for r in calm.collect()) == sorted(d for d, t in scores.items() if not t)

    kept = {r["doc_id"]: r for r in calm.collect()}
    single = stages["simhash_near_dedup"](spark, calm, sf_dir).cache()
    assert single.columns == df.columns
    want = {c for _, _, c in test_simhash.expected([(d, r["text"]) for d, r in sorted(kept.items())])}
    assert {r["doc_id"] for r in single.collect()} == want and single.count() == len(want)

    _, items = given(spark, sf_dir, "benchmark")
    own = [i for i in items]
    clean = stages["decontamination"](spark, single, sf_dir).cache()
    assert clean.columns == df.columns
    gone = want - {r["doc_id"] for r in clean.collect()}
    assert gone == {d for d, _ in test_decontamination.expected([(d, kept[d]["text"]) for d in sorted(want)], [(i["item_id"], i["text"]) for i in own])}

    safe = stages["secret_scan"](spark, clean, sf_dir).cache()
    assert safe.columns == df.columns and safe.count() == clean.count()
    before = {r["doc_id"]: r["text"] or "" for r in clean.collect()}
    for r in safe.collect():
        spans = test_secret_scan.base_spans(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"] or "")
        assert spans or r["text"] == before[r["doc_id"]] or "[SECRET]" in r["text"]

    last = stages["pieces"](spark, safe, sf_dir).collect()
    assert sorted(map(tuple, last)) == sorted(test_pieces.expected([(r["doc_id"], r["text"]) for r in safe.collect()]))
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(map(tuple, last))


def test_registered():
    import __spark_entry__ as entry

    named = entry.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(named)
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _key string, _spans string, _kept string, _kept_text string, _copy string, id string, key string, row string, spans string, found string, fp bigint, root bigint, first string, text_hash string"


def test_clashing_columns(spark):
    """Whatever the other columns are called, the two stages that join keep them as they are."""
    key = "password = hunter2secret99"
    texts = [(1, "one two three four five six seven eight"), (2, "one two three four five six seven eight"), (3, f"other text {key} of this"), (None, key), (None, None), (3, f"other text {key} of this")]
    extra = CLASHING.count(",") + 1 - 5
    rows = spark.createDataFrame([(d, t, "en", f"owner{i}/repo", 5, *[str(c) if not 11 <= c <= 12 else c for c in range(extra)]) for i, (d, t) in enumerate(texts)], CLASHING)
    clean = cp.redact_secrets(spark, rows, "")
    assert clean.columns == rows.columns
    got = clean.collect()
    assert len(got) == 6 and sum("[SECRET]" in (r["text"] or "") for r in got) == 3
    assert all(r["n_chars"] == len(r["text"] or "") if r["text"] is not None else r["n_chars"] is None for r in got)
    kept = cp.drop_near_copies(spark, rows, "")
    assert kept.columns == rows.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None", "None"]
    assert all(r["_spans"] == "2" and r["found"] == "10" for r in [*got, *kept.collect()])


def test_planted_toxic_and_secrets(spark, sf_dir):
    """What the toxicity stage rejects and the secret stage replaces, told from the planted rows and not from the stage."""
    sf_dir = sf_dir.replace("0.01", "0.1")  # enough labelled rows for shares
    df, rows = given(spark, sf_dir)
    labels, marks = given(spark, sf_dir, "labels")
    toxic = {r["doc_id"] for r in marks if r["toxic"] == 1}
    clean = {r["doc_id"] for r in marks if r["toxic"] == 0}
    kept = {r["doc_id"] for r in cp.drop_toxic(spark, df, sf_dir).collect()}
    present = {r["doc_id"] for r in rows}
    assert len(toxic & present - kept) >= 0.8 * len(toxic & present)
    assert len(clean & present & kept) >= 0.99 * len(clean & present)

    own = "token: Zx81kQp77LmN0aB"
    example = "password = changeme-please"
    texts = [(i, f"first words {example} last {i}", f"owner{i}/repo") for i in range(8)]
    texts += [(100, f"before {own} after, {own}!", "solo/repo"), (101, "nothing of that kind", "solo/repo"), (102, None, "solo/repo")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    safe = {r["doc_id"]: r for r in cp.redact_secrets(spark, docs, "").collect()}
    assert safe[100]["text"] == "before [SECRET] after, [SECRET]!" and safe[100]["n_chars"] == len(safe[100]["text"])
    assert all(safe[d]["text"] == t for d, t, _ in texts if d != 100)
