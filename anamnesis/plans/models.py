"""Classifiers: naive Bayes in all forms, rule table, forests, boosting, networks, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import bayes as N
from ..operators import ensembles as E
from ..operators import features as L
from ..operators.sizes import settle, small_side, store
from . import roles as S
from .registry import Tables, query
from .roles import n64, r6


def training(t: Tables, label: str = "nation") -> DataFrame:
    """Records with their label and tokens (codes and gender), joined once for fit and scores."""
    rows = S.coded(t) if label == "label" else S.records(t).withColumn("label", F.col(label).cast("string"))
    kept = store(rows.select("row_id", "label", "source", "gender", "age", "codes"), "records")
    return kept.withColumn("tokens", N.bernoulli_tokens("codes", {"gender": F.col("gender") == 1}))


def feature_set(t: Tables) -> DataFrame:
    codes = t.part.select(F.col("p_brand").alias("token")).distinct()
    return codes.unionByName(t.spark.range(1).select(F.lit("gender").alias("token")))


def composite(t: Tables, rows: DataFrame, prior: str = "per_component") -> N.BayesModel:
    return N.fit(rows, "label", "tokens", feature_set(t), ["age"], N.BayesSpec(prior=prior))


def nb_sql(label: str = "nation::VARCHAR", train: str = "true", prior: float = 2.0, gauss: bool = True, tokens: bool = True, smoothing: str = "laplace", gender: bool = True) -> str:
    """The naive Bayes posterior in SQL: ends with pr(row_id, label, source, nc, cand, s, p, rank)."""
    p = "(coalesce(k, 0) + 1.0::DOUBLE) / (n + 2.0::DOUBLE)" if smoothing == "laplace" else "greatest(0.001::DOUBLE, least(0.999::DOUBLE, coalesce(k, 0) / n))"
    extra = "UNION ALL SELECT row_id, 'gender' FROM rec WHERE gender = 1" if gender else ""
    extra_word = "UNION ALL SELECT 'gender'" if gender else ""
    age = "- 0.5 * ln(2 * pi() * (v + 1e-9 * gv)) - (age - mu) * (age - mu) / (2 * (v + 1e-9 * gv))" if gauss else ""
    token = "+ b + coalesce(h.s, 0)" if tokens else ""
    return f"""{S.BASE}, tok AS (SELECT row_id, code FROM sym {extra}), r AS (SELECT row_id, {label} AS label, age::DOUBLE AS age, source, len(codes) AS nc FROM rec),
tr AS (SELECT * FROM r WHERE {train}), cls AS (SELECT label, count(*)::DOUBLE AS n, avg(age) AS mu, var_pop(age) AS v FROM tr GROUP BY 1),
gv AS (SELECT var_pop(age) AS gv, count(*)::DOUBLE AS total FROM tr), vocab AS (SELECT code FROM dic {extra_word}),
cnt AS (SELECT label, code, count(*) AS k FROM tr JOIN tok USING (row_id) GROUP BY ALL),
p AS (SELECT label, code, {p} AS p FROM cls CROSS JOIN vocab LEFT JOIN cnt USING (label, code)),
base AS (SELECT label, sum(ln(1 - p)) AS b FROM p GROUP BY 1),
h AS (SELECT row_id, p.label AS cand, sum(ln(p) - ln(1 - p)) AS s FROM tok JOIN p USING (code) GROUP BY ALL),
sc AS (SELECT r.row_id, r.label, source, nc, c.label AS cand, {prior}::DOUBLE * ln(c.n / total) {token} {age} AS s
  FROM r CROSS JOIN gv CROSS JOIN cls c JOIN base ON base.label = c.label LEFT JOIN h ON h.row_id = r.row_id AND h.cand = c.label),
z AS (SELECT row_id, mx + ln(sum(exp(s - mx))) AS lz FROM (SELECT *, max(s) OVER (PARTITION BY row_id) AS mx FROM sc) GROUP BY row_id, mx),
pr AS (SELECT sc.*, exp(s - lz) AS p, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, cand) AS rank FROM sc JOIN z USING (row_id))"""


FIRST_SOURCE = "source = 'F'"
BEST = "SELECT row_id, cand AS pred, round(p, 6) AS p FROM pr WHERE rank = 1"


def best(scored: DataFrame) -> DataFrame:
    top = F.get("top", 0)
    return scored.select("row_id", top["label"].alias("pred"), r6(top["p"]).alias("p"))


@query("m1_hand_bayes", f"{nb_sql(prior=0, gauss=False, smoothing='clamp', gender=False)} {BEST}")
def m1(t: Tables) -> DataFrame:
    rows = training(t).withColumn("tokens", F.col("codes"))
    model = N.fit(rows, "label", "tokens", feature_set(t).where("token <> 'gender'"), spec=N.BayesSpec("clamp", prior="uniform", components=1))
    return best(model.score(rows, "tokens", 1))


@query("m2_bernoulli_prior", f"{nb_sql(prior=1, gauss=False)} {BEST}")
def m2(t: Tables) -> DataFrame:
    rows = training(t)
    return best(N.fit(rows, "label", "tokens", feature_set(t), spec=N.BayesSpec(components=1)).score(rows, "tokens", 1))


@query("m2_bernoulli_uniform", f"{nb_sql(prior=0, gauss=False)} {BEST}")
def m2_uniform(t: Tables) -> DataFrame:
    rows = training(t)
    return best(N.fit(rows, "label", "tokens", feature_set(t), spec=N.BayesSpec(prior="uniform", components=1)).score(rows, "tokens", 1))


@query("m3_gaussian", f"{nb_sql(prior=0, tokens=False)} {BEST}")
def m3(t: Tables) -> DataFrame:
    rows = training(t)
    return best(N.fit_gaussian(rows, "label", ["age"]).score(rows, "tokens", 1))


@query("m4_single_column_multinomial", f"{nb_sql(prior=2)} {BEST}")
def m4(t: Tables) -> DataFrame:
    """A one-column multinomial part adds nothing but its prior: Bernoulli and race part."""
    rows = training(t)
    return best(composite(t, rows).score(rows, "tokens", 1))


@query("m5_composite_three_parts", f"{nb_sql(prior=3)} {BEST}")
def m5(t: Tables) -> DataFrame:
    rows = training(t)
    model = N.fit(rows, "label", "tokens", feature_set(t), ["age"], N.BayesSpec(components=3))
    return best(model.score(rows, "tokens", 1))


def race_token(column: str = "race") -> Column:
    return F.concat(F.lit("race_"), F.col(column).cast("string"))


def with_race(t: Tables) -> DataFrame:
    """Records with codes, gender and race (one-hot) as tokens, classed by condition."""
    rows = store(S.records(t).select("row_id", "label", "gender", "race", "age", "codes"), "records")
    return rows.withColumn("tokens", F.array_compact(F.array_append(N.bernoulli_tokens("codes", {"gender": F.col("gender") == 1}), race_token())))


def races(t: Tables) -> DataFrame:
    return t.spark.range(len(S.SEGMENTS)).select(race_token("id").alias("token"))


#: Weights of the races in each class: th(label, race, w).
RACE_SQL = """th AS (SELECT c.label, k.race, ln((coalesce(x.n, 0) + 1.0::DOUBLE) / (c.n + 5)) AS w
  FROM (SELECT label, count(race) AS n FROM rec GROUP BY 1) c CROSS JOIN (SELECT range AS race FROM range(5)) k
  LEFT JOIN (SELECT label, race, count(*) AS n FROM rec GROUP BY ALL) x ON x.label = c.label AND x.race = k.race)"""


@query(
    "m4_race_part",
    f"""{S.BASE}, {RACE_SQL}, cls AS (SELECT label, count(*)::DOUBLE AS n FROM rec GROUP BY 1),
sc AS (SELECT row_id, c.label, ln(c.n / (SELECT sum(n) FROM cls)) + coalesce(w, 0) AS s FROM rec CROSS JOIN cls c LEFT JOIN th ON th.label = c.label AND th.race = rec.race),
z AS (SELECT row_id, ln(sum(exp(s))) AS lz FROM sc GROUP BY 1)
SELECT row_id, label, round(s - lz, 6) AS log_p FROM sc JOIN z USING (row_id)""",
)
def m4_race(t: Tables) -> DataFrame:
    """The race written one-hot as a multinomial part: every class of every record."""
    rows = with_race(t)
    model = N.fit_multinomial(N.token_counts(rows, "label", "tokens"), races(t))
    return every_class(model, rows)


def every_class(model: N.BayesModel, rows: DataFrame) -> DataFrame:
    flat = model.log_probabilities(rows, "tokens").select("row_id", F.explode("log_p").alias("c"))
    return flat.select("row_id", "c.label", r6(F.col("c.log_p")).alias("log_p"))


def production_parts(t: Tables, rows: DataFrame) -> list[N.BayesModel]:
    """Gender and symptoms as Bernoulli parts, race as a multinomial, age as a Gaussian one: all from one count table."""
    counts, stats = N.statistics(rows, "label", "tokens", ["age"])
    one = N.BayesSpec(components=1)
    words = feature_set(t)
    none = words.where(F.lit(False))
    return [
        N.fit_counts(counts, None, words.where("token = 'gender'"), spec=one),
        N.fit_multinomial(counts, races(t), one),
        N.fit_counts(counts, stats, none, ["age"], one),
        N.fit_counts(counts, None, words.where("token <> 'gender'"), spec=one),
    ]


@query(
    "m5_production_parts",
    f"""{nb_sql(label='label', prior=4)}, {RACE_SQL},
sc2 AS (SELECT row_id, cand AS label, s + coalesce(w, 0) AS s FROM sc JOIN rec USING (row_id) LEFT JOIN th ON th.label = cand AND th.race = rec.race),
z2 AS (SELECT row_id, mx + ln(sum(exp(s - mx))) AS lz FROM (SELECT *, max(s) OVER (PARTITION BY row_id) AS mx FROM sc2) GROUP BY row_id, mx)
SELECT row_id, label, round(s - lz, 6) AS log_p FROM sc2 JOIN z2 USING (row_id)""",
)
def m5_production(t: Tables) -> DataFrame:
    """Four parts, their joint log-likelihoods summed: every class of every record, the prior counted four times."""
    rows = with_race(t)
    return every_class(N.compose(*production_parts(t, rows)), rows)


@query("m6_composite_top5", f"{nb_sql(prior=2)} SELECT row_id, rank, cand AS label, round(p, 6) AS p FROM pr WHERE rank <= 5")
def m6(t: Tables) -> DataFrame:
    rows = training(t)
    flat = composite(t, rows).score(rows, "tokens", 5).select("row_id", F.posexplode("top"))
    return flat.select("row_id", n64(F.col("pos") + 1).alias("rank"), "col.label", r6(F.col("col.p")).alias("p"))


CAT_SQL = f"""{S.BASE}, f AS (SELECT l_orderkey AS row_id, p_brand AS s, max(l_linenumber) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT row_id, label FROM rec), cls AS (SELECT label, count(*)::DOUBLE AS n FROM r GROUP BY 1),
w AS (SELECT DISTINCT s, v FROM f), k AS (SELECT s, count(*) + 1 AS k FROM w GROUP BY 1),
cnt AS (SELECT label, s, v, count(*) AS c FROM f JOIN r USING (row_id) GROUP BY ALL),
g AS (SELECT cls.label, n, w.s, w.v, k, coalesce(c, 0) AS c FROM cls CROSS JOIN (SELECT w.s AS s, v, k FROM w JOIN k ON k.s = w.s) w LEFT JOIN cnt ON cnt.label = cls.label AND cnt.s = w.s AND cnt.v = w.v),
q AS (SELECT *, (n - sum(c) OVER (PARTITION BY label, s) + 1)::DOUBLE / (n + k) AS p0, (c + 1)::DOUBLE / (n + k) AS p FROM g),
base AS (SELECT label, sum(ln(p0)) AS b FROM (SELECT DISTINCT label, s, p0 FROM q) GROUP BY 1),
h AS (SELECT row_id, label AS cand, sum(ln(p) - ln(p0)) AS d FROM f JOIN q USING (s, v) GROUP BY ALL),
sc AS (SELECT r.row_id, c.label AS cand, b + coalesce(d, 0) + ln(n / (SELECT sum(n) FROM cls)) AS s FROM r CROSS JOIN cls c JOIN base ON base.label = c.label LEFT JOIN h ON h.row_id = r.row_id AND h.cand = c.label)
SELECT row_id, arg_max(cand, s) AS pred, round(1 / sum(exp(s - mx)), 6) AS p FROM (SELECT *, max(s) OVER (PARTITION BY row_id) AS mx FROM sc) GROUP BY row_id"""


@query("m7_categorical", CAT_SQL)
def m7(t: Tables) -> DataFrame:
    facts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    values = facts.groupBy(F.col("l_orderkey").alias("id"), "p_brand").agg(F.max("l_linenumber").alias("v"))
    sets = values.groupBy("id").agg(F.array_sort(F.collect_list(F.concat_ws("|", "p_brand", F.col("v").cast("string")))).alias("tokens"))
    rows = S.conditions(t).join(sets, F.col("row_id") == F.col("id"), "left")
    rows = rows.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    return best(N.fit_categorical(rows, "label", "tokens").score(rows, "tokens", 1))


@query("m8_partial_fit", f"{nb_sql(prior=2)} {BEST}")
def m8(t: Tables) -> DataFrame:
    """Three batches are counted apart and merged; the model equals that of all rows at once."""
    rows = training(t)
    batches = [rows.where(F.col("source") == s) for s in ("F", "O", "P")]
    parts = [N.statistics(b, "label", "tokens", ["age"]) for b in batches]
    counts, stats = N.merge_counts([c for c, _ in parts]), N.merge_moments([s for _, s in parts])
    return best(N.fit_counts(counts, stats, feature_set(t), ["age"]).score(rows, "tokens", 1))


def vectors(t: Tables) -> DataFrame:
    return E.dense_features(t.embeddings, "embedding").select("vec_id", F.col("label").cast("double").alias("label"), "features")


@query("m9_random_forest")
def m9(t: Tables) -> DataFrame:
    rows = vectors(t)
    scored = E.random_forest(trees=20, depth=8, seed=1).fit(rows).transform(rows)
    return E.predictions(scored, "vec_id")


@query("m10_forest_by_chunk")
def m10(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumn("chunk", F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1) < "8")
    rows = E.dense_features(rows, "embedding").withColumn("label", F.col("label").cast("double"))
    parts = [rows.where("chunk"), rows.where("not chunk")]
    models = [E.random_forest(trees=10, depth=6, seed=i).fit(p) for i, p in enumerate(parts)]
    return E.averaged(models, rows, "vec_id")


@query("m11_gradient_boosting")
def m11(t: Tables) -> DataFrame:
    rows = vectors(t)
    scored = E.boosted(rounds=2, depth=3, seed=1).fit(rows).transform(rows)
    return E.predictions(scored, "vec_id")


@query("m12_perceptron")
def m12(t: Tables) -> DataFrame:
    rows = vectors(t)
    scored = E.perceptron([64, 32, 10], rounds=20, seed=1).fit(rows).transform(rows)
    return E.predictions(scored, "vec_id")


@query(
    "m13_rule_table",
    f"""{S.BASE}, c AS (SELECT array_to_string(codes, ';') AS mask, label, count(*) AS n FROM rec WHERE len(codes) > 0 GROUP BY ALL),
rule AS (SELECT mask, label AS pred FROM c QUALIFY row_number() OVER (PARTITION BY mask ORDER BY n DESC, label) = 1)
SELECT row_id, label, pred FROM rec JOIN rule ON array_to_string(codes, ';') = mask WHERE len(codes) > 0""",
)
def m13(t: Tables) -> DataFrame:
    rows = store(S.reported(t).select("row_id", "label", "codes"), "records")
    rules = settle(N.rule_table(rows, "label", "codes").select("mask", F.col("rule").alias("pred")))
    return rows.withColumn("mask", F.array_join("codes", ";")).join(small_side(rules, 64, text_columns=["mask", "pred"]), "mask").select("row_id", "label", "pred")


def record_vectors(t: Tables) -> tuple[DataFrame, list[str]]:
    """Sparse design vectors with a numeric label, and the names of their positions."""
    words = L.code_list(S.dictionary(t))
    rows = store(L.ordinal(S.records(t), "label", "y"), "records")
    vectors = L.sparse_rows(rows, words).select("row_id", F.col("y").cast("double").alias("label"), "features")
    return vectors, ["gender", "race", "age", *words]


@query("m9_forest_on_records")
def m9_records(t: Tables) -> DataFrame:
    rows, _ = record_vectors(t)
    scored = E.random_forest(trees=10, depth=6, seed=1).fit(rows).transform(rows)
    return E.predictions(scored, "row_id")


@query("m14_feature_importance")
def m14(t: Tables) -> DataFrame:
    rows, names = record_vectors(t)
    model = E.random_forest(trees=10, depth=6, seed=1).fit(rows)
    return E.importances(t.spark, model, names)


@query("m15_grid_search")
def m15(t: Tables) -> DataFrame:
    return E.grid_search(vectors(t), {"numTrees": [5, 10], "maxDepth": [3, 6]}, seed=1)


@query("m16_batch_inference", f"{nb_sql(train=FIRST_SOURCE)} SELECT source AS dataset, row_id, cand AS pred, round(p, 6) AS p FROM pr WHERE rank = 1")
def m16(t: Tables) -> DataFrame:
    """One model, fitted on the first source, applied to all named test sets in one pass."""
    rows = training(t)
    model = composite(t, rows.where("source = 'F'"))
    scored = model.score(rows, "tokens", 1)
    top = F.get("top", 0)
    return scored.select(F.col("source").alias("dataset"), "row_id", top["label"].alias("pred"), r6(top["p"]).alias("p"))


@query("m17_single_record", f"{nb_sql(prior=2)} SELECT rank, cand AS label, round(p, 6) AS p FROM pr WHERE row_id = 42 AND rank <= 5")
def m17(t: Tables) -> DataFrame:
    rows = training(t)
    one = composite(t, rows).score(rows.where("row_id = 42"), "tokens", 5).select(F.posexplode("top"))
    return one.select(n64(F.col("pos") + 1).alias("rank"), "col.label", r6(F.col("col.p")).alias("p"))
