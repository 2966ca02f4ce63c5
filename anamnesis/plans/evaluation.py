"""Scores of predictions: accuracy, confusion, areas, confidence, thresholds, curves, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import bayes as N
from ..operators import curves as U
from ..operators import evaluation as V
from ..operators import scores as K
from ..session import scratch_path
from ..sources.sinks import write_partitioned
from . import roles as S
from .models import FIRST_SOURCE, best, composite, feature_set, nb_sql, training
from .registry import Tables, query
from .roles import n64, r6
from .values import runs, RUNS

PR = f"""{nb_sql()}, pd AS (SELECT row_id, any_value(label) AS label, any_value(source) AS source, any_value(nc) AS nc, max(CASE WHEN rank = 1 THEN cand END) AS pred, max(p) AS best,
  max(CASE WHEN label = cand THEN rank END) AS own_rank, max(CASE WHEN label = cand THEN p END) AS own FROM pr GROUP BY row_id)"""
PR5 = f"""{nb_sql(label='label')}, pd AS (SELECT row_id, any_value(label) AS label, any_value(source) AS source, max(CASE WHEN rank = 1 THEN cand END) AS pred FROM pr GROUP BY row_id)"""


def scored(t: Tables, label: str = "nation", top: int = 5, train: str | None = None) -> DataFrame:
    rows = training(t, label)
    model = composite(t, rows.where(train) if train else rows)
    return model.score(rows, "tokens", top, "label")


@query("n1_accuracy", f"{PR} SELECT source, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pd GROUP BY source")
def n1(t: Tables) -> DataFrame:
    return scored(t).groupBy("source").agg(r6(F.avg((V.predicted() == F.col("label")).cast("double"))).alias("accuracy"))


@query(
    "n2_top_n",
    f"""{PR} SELECT source, count(*) AS n, round(avg(CASE WHEN own_rank <= 1 AND own > 0 THEN 1.0 ELSE 0.0 END), 6) AS top_1, round(avg(CASE WHEN own_rank <= 3 AND own > 0 THEN 1.0 ELSE 0.0 END), 6) AS top_3,
  round(avg(CASE WHEN own_rank <= 5 AND own > 0 THEN 1.0 ELSE 0.0 END), 6) AS top_5 FROM pd GROUP BY source""",
)
def n2(t: Tables) -> DataFrame:
    tops = V.accuracy(scored(t), "label", ["source"], (1, 3, 5))
    return tops.select("source", "n", *[r6(F.col(f"top_{k}")).alias(f"top_{k}") for k in (1, 3, 5)])


CELLS = "cells AS (SELECT label AS truth, pred, count(*) AS n FROM pd GROUP BY ALL)"
PER_CLASS = f"""{CELLS}, l AS (SELECT truth AS label FROM cells UNION SELECT pred FROM cells),
pc AS (SELECT label, coalesce((SELECT sum(n) FROM cells WHERE truth = label), 0)::DOUBLE AS support, coalesce((SELECT sum(n) FROM cells WHERE pred = label), 0)::DOUBLE AS predicted,
  coalesce((SELECT sum(n) FROM cells WHERE truth = label AND pred = label), 0)::DOUBLE AS tp FROM l),
sc2 AS (SELECT label, support, predicted, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM pc),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM sc2)"""


@query(
    "n3_precision_recall_f1",
    f"""{PR}, {PER_CLASS} SELECT round(avg(prec), 6) AS precision_macro, round(sum(prec * support) / sum(support), 6) AS precision_weighted, round(avg(rec), 6) AS recall_macro,
  round(sum(rec * support) / sum(support), 6) AS recall_weighted, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f""",
)
def n3(t: Tables) -> DataFrame:
    means = V.averaged_scores(V.class_scores(V.confusion(scored(t), "label")))
    return means.select(*[r6(F.col(c)).alias(c) for c in means.columns])


@query(
    "n4_weighted_precision_zero_division",
    f"""{PR}, {PER_CLASS} SELECT round(sum((CASE WHEN predicted > 0 THEN tp / predicted ELSE 1 END) * support) / sum(support), 6) AS precision_weighted FROM f""",
)
def n4(t: Tables) -> DataFrame:
    means = V.averaged_scores(V.class_scores(V.confusion(scored(t), "label"), zero_division=1.0))
    return means.select(r6(F.col("precision_weighted")).alias("precision_weighted"))


@query("n5_confusion", f"{PR} SELECT label AS truth, pred, count(*) AS n FROM pd GROUP BY ALL")
def n5(t: Tables) -> DataFrame:
    return V.confusion(scored(t), "label")


@query(
    "n6_recall_changes",
    f"""{PR5}, c AS (SELECT source, label, count(*) AS n, count(*) FILTER (WHERE pred = label) AS ok FROM pd GROUP BY ALL),
w AS (SELECT label, max(CASE WHEN source = 'F' THEN ok / n END) AS f, max(CASE WHEN source = 'O' THEN ok / n END) AS o, max(CASE WHEN source = 'P' THEN ok / n END) AS p FROM c GROUP BY label)
SELECT label, round(o - f, 6) AS o_gain, round(p - f, 6) AS p_gain, CASE WHEN o > f AND p > f THEN 'both' WHEN o > f THEN 'o' WHEN p > f THEN 'p' ELSE 'none' END AS better FROM w""",
)
def n6(t: Tables) -> DataFrame:
    cells = V.confusion(scored(t, "label"), "label", ["source"])
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    wide = cells.groupBy(F.col("truth").alias("label")).agg(
        *[
            (F.sum(F.when(F.col("source") == s, hit)) / F.sum(F.when(F.col("source") == s, F.col("n")))).alias(s.lower())
            for s in ("F", "O", "P")
        ]
    )
    o, p = F.col("o") > F.col("f"), F.col("p") > F.col("f")
    return wide.select(
        "label",
        r6(F.col("o") - F.col("f")).alias("o_gain"),
        r6(F.col("p") - F.col("f")).alias("p_gain"),
        F.when(o & p, "both").when(o, "o").when(p, "p").otherwise("none").alias("better"),
    )


@query("n7_precision_per_class", f"{PR}, {PER_CLASS} SELECT label, CAST(support AS BIGINT) AS support, CAST(predicted - tp AS BIGINT) AS fp, round(prec, 6) AS precision FROM f")
def n7(t: Tables) -> DataFrame:
    scores = V.class_scores(V.confusion(scored(t), "label"))
    return scores.select("label", n64("support").alias("support"), n64(F.col("predicted") - F.col("tp")).alias("fp"), r6(F.col("precision")).alias("precision"))


#: More than any label has: areas need the probabilities of all classes.
ALL_CLASSES = 1 << 30


def rounded_top(t: Tables) -> DataFrame:
    rows = scored(t, "label", top=ALL_CLASSES)
    return rows.withColumn("top", F.transform("top", lambda s: F.struct(s["label"].alias("label"), F.round(s["p"], 9).alias("p"))))


@query(
    "n8_auc_one_vs_rest",
    f"""{nb_sql(label='label')}, g AS (SELECT cand, round(p, 9) AS p, count(*) FILTER (WHERE label = cand) AS pos, count(*) FILTER (WHERE label <> cand) AS neg FROM pr GROUP BY ALL),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cand ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT cand, CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos * (below + neg / 2)) / sum(pos) / sum(neg), 6) AS auc FROM b GROUP BY cand""",
)
def n8(t: Tables) -> DataFrame:
    return V.auc_one_vs_rest(rounded_top(t), "label").select("cand", "positives", r6(F.col("auc")).alias("auc"))


@query(
    "n8_auc_pairs",
    f"""{nb_sql(label='label')}, q AS (SELECT label, cand, round(p, 9) AS p FROM pr),
x AS (SELECT DISTINCT a.cand AS cand, b.cand AS rival FROM q a, (SELECT DISTINCT cand FROM q) b WHERE a.cand <> b.cand),
g AS (SELECT x.cand, rival, p, count(*) FILTER (WHERE label = x.cand) AS pos, count(*) FILTER (WHERE label = rival) AS neg FROM x JOIN q ON q.cand = x.cand AND (label = x.cand OR label = rival) GROUP BY ALL),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cand, rival ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
u AS (SELECT cand, rival, sum(pos * (below + neg / 2)) / sum(pos) / sum(neg) AS auc FROM b GROUP BY ALL)
SELECT least(cand, rival) AS a, greatest(cand, rival) AS b, round(avg(auc), 6) AS auc FROM u GROUP BY 1, 2""",
)
def n8_pairs(t: Tables) -> DataFrame:
    return V.auc_pairs(rounded_top(t), "label").withColumn("auc", r6(F.col("auc")))


@query(
    "n9_confidence_buckets",
    f"""{PR}, tags AS (SELECT row_id, 'all' AS bucket FROM pd UNION ALL SELECT row_id, CASE WHEN pred = label THEN 'top1_right' ELSE 'top1_wrong' END FROM pd
UNION ALL SELECT row_id, CASE WHEN own_rank <= 5 AND own > 0 THEN 'in_top5' ELSE 'not_in_top5' END FROM pd)
SELECT bucket, rank, count(*) AS n, round(avg(p), 6) AS mean_p FROM tags JOIN pr USING (row_id) WHERE rank <= 5 GROUP BY ALL""",
)
def n9(t: Tables) -> DataFrame:
    flat = V.confidence_buckets(scored(t), "label")
    return flat.groupBy("bucket", n64("rank").alias("rank")).agg(S.count_rows().alias("n"), r6(F.avg("p")).alias("mean_p"))


CUTS = [0.05, 0.055, 0.06, 0.07, 0.08, 0.1]
SWEEP = f"""{PR}, sw AS (SELECT threshold, count(*) FILTER (WHERE best >= threshold) AS allowed, count(*) FILTER (WHERE best >= threshold AND pred = label) AS allowed_top1,
  count(*) FILTER (WHERE best >= threshold AND own_rank <= 5) AS allowed_topn, count(*) FILTER (WHERE best < threshold) AS rejected, count(*) FILTER (WHERE best < threshold AND pred = label) AS rejected_top1,
  count(*) FILTER (WHERE best < threshold AND own_rank <= 5) AS rejected_topn FROM pd, unnest([{', '.join(f'{c}::DOUBLE' for c in CUTS)}]) c(threshold) GROUP BY threshold)"""


@query("n10_threshold_sweep", f"{SWEEP} SELECT * FROM sw")
def n10(t: Tables) -> DataFrame:
    return V.threshold_sweep(scored(t), "label", CUTS)


@query(
    "n11_threshold_summary",
    f"""{SWEEP} SELECT threshold, round(allowed / (allowed + rejected), 6) AS diagnosed, round(CASE WHEN allowed > 0 THEN allowed_top1 / allowed END, 6) AS top1, round(CASE WHEN allowed > 0 THEN allowed_topn / allowed END, 6) AS topn FROM sw""",
)
def n11(t: Tables) -> DataFrame:
    out = V.threshold_summary(V.threshold_sweep(scored(t), "label", CUTS))
    return out.select("threshold", *[r6(F.col(c)).alias(c) for c in ("diagnosed", "top1", "topn")])


@query(
    "n12_misfires",
    f"""{PR}, m AS (SELECT pr.label AS truth, CAST(own_rank <= 5 AS INTEGER) AS inside, cand AS pred, count(*) AS n FROM pr JOIN pd USING (row_id) WHERE rank <= 5 AND cand <> pr.label AND pr.label IN ('3', '7', '11') GROUP BY ALL)
SELECT truth, inside, pred, n, row_number() OVER (PARTITION BY truth, inside ORDER BY n DESC, pred) AS rank FROM m QUALIFY rank <= 5""",
)
def n12(t: Tables) -> DataFrame:
    rows = training(t)
    model = composite(t, rows)
    # Only the chosen classes are scored.
    chosen = model.score(rows.where(F.col("label").isin("3", "7", "11")), "tokens", 5, "label")
    return V.ranked_misfires(V.misfires(chosen, "label"), ["truth", "inside"], 5).withColumn("rank", n64("rank"))


@query(
    "n13_cross_dataset",
    f"""{nb_sql(train=FIRST_SOURCE)}, pd AS (SELECT row_id, source, max(CASE WHEN label = cand THEN rank END) AS own_rank FROM pr GROUP BY ALL)
SELECT source, count(*) AS n, round(avg(CASE WHEN own_rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS top_1, round(avg(CASE WHEN own_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top_5 FROM pd GROUP BY source""",
)
def n13(t: Tables) -> DataFrame:
    tops = V.accuracy(scored(t, train=FIRST_SOURCE), "label", ["source"])
    return tops.select("source", "n", r6(F.col("top_1")).alias("top_1"), r6(F.col("top_5")).alias("top_5"))


def _grid_sql(folds: int, fractions: list[float], out: str) -> str:
    """Naive Bayes per (fold, training size) in SQL, label = priority."""
    levels = " ".join(f"WHEN rn <= round(n * {f}::DOUBLE) THEN {i}" for i, f in enumerate(fractions))
    return f"""{S.BASE}, tok AS (SELECT row_id, code FROM sym UNION ALL SELECT row_id, 'gender' FROM rec WHERE gender = 1),
o AS (SELECT row_id, label, age::DOUBLE AS age, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('-', '0', row_id::VARCHAR)), row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM rec),
r AS (SELECT row_id, label, age, (rn - 1) % {folds} AS fold, CASE {levels} END AS level FROM o),
g AS (SELECT f.fold AS fold, s.level AS level FROM range({folds}) f(fold), range({len(fractions)}) s(level)),
tr AS (SELECT g.fold, g.level, row_id, label, age FROM g JOIN r ON r.fold <> g.fold AND r.level <= g.level),
cls AS (SELECT fold, level, label, count(*)::DOUBLE AS n, avg(age) AS mu, var_pop(age) AS v FROM tr GROUP BY ALL),
gv AS (SELECT fold, level, count(*)::DOUBLE AS total, var_pop(age) AS gv FROM tr GROUP BY ALL),
vocab AS (SELECT code FROM dic UNION ALL SELECT 'gender'),
cnt AS (SELECT fold, level, label, code, count(*) AS k FROM tr JOIN tok USING (row_id) GROUP BY ALL),
p AS (SELECT fold, level, label, code, (coalesce(k, 0) + 1.0::DOUBLE) / (n + 2.0::DOUBLE) AS p FROM cls CROSS JOIN vocab LEFT JOIN cnt USING (fold, level, label, code)),
base AS (SELECT fold, level, label, sum(ln(1 - p)) AS b FROM p GROUP BY ALL),
ev AS (SELECT g.fold, g.level, row_id, label, age, CASE WHEN r.fold = g.fold THEN 'test' ELSE 'train' END AS role FROM g JOIN r ON r.fold = g.fold OR r.level <= g.level),
h AS (SELECT fold, level, row_id, p.label AS cand, sum(ln(p) - ln(1 - p)) AS s FROM tok JOIN ev USING (row_id) JOIN p USING (fold, level, code) GROUP BY ALL),
sc AS (SELECT c.fold, c.level, role, r.row_id, r.label, c.label AS cand, 2 * ln(c.n / total) + b + coalesce(h.s, 0) - 0.5 * ln(2 * pi() * (v + 1e-9 * gv)) - (age - mu) * (age - mu) / (2 * (v + 1e-9 * gv)) AS s
  FROM ev r JOIN cls c ON c.fold = r.fold AND c.level = r.level JOIN gv ON gv.fold = c.fold AND gv.level = c.level JOIN base ON base.fold = c.fold AND base.level = c.level AND base.label = c.label
  LEFT JOIN h ON h.row_id = r.row_id AND h.fold = c.fold AND h.level = c.level AND h.cand = c.label),
bst AS (SELECT fold, level, role, row_id, label, arg_max(cand, s) AS pred FROM sc GROUP BY ALL),
acc AS (SELECT fold, level, role, count(*) AS n, avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM bst GROUP BY ALL) {out}"""


def grid_options(t: Tables) -> list:
    return ["label", "tokens", ["row_id"], feature_set(t), ["age"]]


@query(
    "n14_learning_curve",
    _grid_sql(
        3,
        [0.25, 0.5, 1.0],
        """SELECT CAST(level AS BIGINT) AS level, round(avg(acc) FILTER (WHERE role = 'test'), 6) AS mean, round(stddev_pop(acc) FILTER (WHERE role = 'test'), 6) AS std,
  round(avg(acc) FILTER (WHERE role = 'train'), 6) AS train_mean, round(stddev_pop(acc) FILTER (WHERE role = 'train'), 6) AS train_std FROM acc GROUP BY level""",
    ),
)
def n14(t: Tables) -> DataFrame:
    curve = U.learning_curve(training(t, "label"), *grid_options(t), [0.25, 0.5, 1.0], 3, N.BayesSpec())
    test, train = (F.when(F.col("role") == role, F.col("top_1")) for role in ("test", "train"))
    sides = {"mean": F.avg(test), "std": F.stddev_pop(test), "train_mean": F.avg(train), "train_std": F.stddev_pop(train)}
    return curve.groupBy(n64("level").alias("level")).agg(*[r6(c).alias(name) for name, c in sides.items()])


@query(
    "g10_curve_cells",
    _grid_sql(3, [0.25, 0.5, 1.0], "SELECT CAST(level AS BIGINT) AS level, CAST(fold AS BIGINT) AS fold, role, n, round(acc, 6) AS score FROM acc"),
)
def g10_cells(t: Tables) -> DataFrame:
    """Every cell of the grid with its rows and score, held out and trained on."""
    curve = U.learning_curve(training(t, "label"), *grid_options(t), [0.25, 0.5, 1.0], 3, N.BayesSpec())
    return curve.select(n64("level").alias("level"), n64("fold").alias("fold"), "role", "n", r6(F.col("top_1")).alias("score"))


@query("n14_curve_times")
def n14_times(t: Tables) -> DataFrame:
    """Seconds of fit and score of every cell, with the rows that were counted meanwhile."""
    return U.curve_times(training(t, "label"), *grid_options(t), [0.5, 1.0], 2, N.BayesSpec())


LOG = """lg AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'nb' ELSE 'rf' END AS model, year(o_orderdate) AS dataset, o_orderpriority[1]::BIGINT AS fold, CASE WHEN o_totalprice < 250000 THEN 0.5 ELSE 1.0 END::DOUBLE AS size, o_totalprice AS score FROM orders)"""


def run_log(t: Tables) -> DataFrame:
    """Orders as a run log: model, dataset, fold, training size, score."""
    return t.orders.select(
        F.when(F.col("o_orderstatus") == "F", "nb").otherwise("rf").alias("model"),
        F.year("o_orderdate").cast("bigint").alias("dataset"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("fold"),
        F.when(F.col("o_totalprice") < 250000, 0.5).otherwise(1.0).alias("size"),
        F.col("o_totalprice").alias("score"),
    )


@query("n15_fold_mean_full_size", f"WITH {LOG} SELECT fold, round(avg(score), 6) AS score FROM lg WHERE size = 1 GROUP BY fold")
def n15(t: Tables) -> DataFrame:
    return run_log(t).where(F.col("size") == 1.0).groupBy("fold").agg(F.round(F.avg("score"), 6).alias("score"))


@query(
    "n16_pareto",
    f"""{RUNS} SELECT run, round(acc, 6) AS acc, t FROM m QUALIFY coalesce(acc > max(acc) OVER (ORDER BY t, acc DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)""",
)
def n16(t: Tables) -> DataFrame:
    return K.pareto_front(runs(t), "acc", "t").select("run", F.round("acc", 6).alias("acc"), "t")


@query(
    "n16_cheapest_near_best",
    f"""{RUNS} SELECT arg_min(run, (t, run)) AS run, min(t) AS t, count(*) AS near FROM m WHERE acc >= (SELECT max(acc) FROM m) * (1 - 0.05::DOUBLE)""",
)
def n16_near(t: Tables) -> DataFrame:
    return K.near_best(runs(t), "acc", 0.05).agg(F.min_by("run", F.struct("t", "run")).alias("run"), F.min("t").alias("t"), S.count_rows().alias("near"))


@query(
    "n17_wide_report",
    f"""WITH {LOG}, a AS (SELECT dataset, model, avg(score) AS s, max(score) AS m FROM lg GROUP BY ALL)
SELECT dataset, round(max(CASE WHEN model = 'nb' THEN s END), 6) AS nb_mean, round(max(CASE WHEN model = 'nb' THEN m END), 6) AS nb_max, round(max(CASE WHEN model = 'rf' THEN s END), 6) AS rf_mean, round(max(CASE WHEN model = 'rf' THEN m END), 6) AS rf_max FROM a GROUP BY dataset""",
)
def n17(t: Tables) -> DataFrame:
    wide = run_log(t).groupBy("dataset").pivot("model", ["nb", "rf"]).agg(
        F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("max")
    )
    return wide


@query(
    "n18_running_accuracy",
    f"""{PR5}, b AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE pred = label) AS ok FROM pd GROUP BY 1)
SELECT source, round(sum(ok) OVER w / sum(n) OVER w, 6) AS accuracy FROM b WINDOW w AS (ORDER BY source)""",
)
def n18(t: Tables) -> DataFrame:
    """Correct and total are kept per batch and summed batch after batch."""
    hits = scored(t, "label").groupBy("source").agg(S.count_rows().alias("n"), F.count_if(V.predicted() == F.col("label")).alias("ok"))
    upto = Window.orderBy("source")
    return hits.select("source", r6(F.sum("ok").over(upto) / F.sum("n").over(upto)).alias("accuracy"))


@query(
    "n19_few_symptom_accuracy",
    f"""{PR} SELECT CAST(nc < 3 AS INTEGER) AS few, count(*) AS n, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pd GROUP BY 1""",
)
def n19(t: Tables) -> DataFrame:
    few = (F.size("codes") < 3).cast("int")
    return scored(t).groupBy(few.alias("few")).agg(S.count_rows().alias("n"), r6(F.avg((V.predicted() == F.col("label")).cast("double"))).alias("accuracy"))


@query(
    "n20_cross_validation",
    _grid_sql(3, [1.0], "SELECT round(avg(acc), 6) AS mean, CAST(arg_max(fold, acc) AS BIGINT) AS best_fold, round(max(acc), 6) AS best FROM acc WHERE role = 'test'"),
)
def n20(t: Tables) -> DataFrame:
    folds = U.cross_validation(training(t, "label"), *grid_options(t), 3, N.BayesSpec()).fold_scores((1,))
    return folds.agg(r6(F.avg("top_1")).alias("mean"), n64(F.max_by("fold", "top_1")).alias("best_fold"), r6(F.max("top_1")).alias("best"))


@query(
    "n20_kept_model",
    _grid_sql(
        3,
        [1.0],
        """, held AS (SELECT row_id, cand, s, max(s) OVER (PARTITION BY row_id) AS mx FROM sc
  WHERE role = 'test' AND fold = (SELECT fold FROM acc WHERE role = 'test' ORDER BY acc DESC, fold LIMIT 1))
SELECT row_id, arg_max(cand, s) AS pred, round(1 / sum(exp(s - mx)), 6) AS p FROM held GROUP BY row_id""",
    ),
)
def n20_kept(t: Tables) -> DataFrame:
    """The model of the best fold, saved, loaded and applied to the rows that it has not seen."""
    run = U.cross_validation(training(t, "label"), *grid_options(t), 3, N.BayesSpec())
    fold, model = run.keep_best()
    path = scratch_path(t.spark, "kept")
    model.save(path)
    held = run.rows.where(F.col("fold") == fold)
    return best(N.BayesModel.load(t.spark, path).score(held, "tokens", 1))


@query(
    "n21_model_comparison",
    f"""WITH {LOG}, a AS (SELECT size, model, avg(score) AS s FROM lg GROUP BY ALL)
SELECT size, round(max(CASE WHEN model = 'nb' THEN s END), 6) AS nb, round(max(CASE WHEN model = 'rf' THEN s END), 6) AS rf FROM a GROUP BY size""",
)
def n21(t: Tables) -> DataFrame:
    return run_log(t).groupBy("size").pivot("model", ["nb", "rf"]).agg(F.round(F.avg("score"), 6))


@query(
    "n22_confused_side_by_side",
    """WITH c AS (SELECT l_returnflag AS condition, l_linestatus AS model, p_brand AS pred, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY condition, model ORDER BY n DESC, pred) AS rank FROM c QUALIFY rank <= 5)
SELECT a.condition, a.rank, a.pred AS first, b.pred AS second, CASE WHEN a.condition IN ('A', 'R') THEN 'x' ELSE 'y' END AS specialty FROM r a JOIN r b ON a.condition = b.condition AND a.rank = b.rank AND a.model = 'F' AND b.model = 'O'""",
)
def n22(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_partkey", F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("model")).agg(S.count_rows().alias("n"))
    cells = counts.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("condition", "model", F.col("p_brand").alias("pred")).agg(F.sum("n").alias("n"))
    ranked = V.ranked_misfires(cells, ["condition", "model"], 5)
    one = ranked.where("model = 'F'").select("condition", "rank", F.col("pred").alias("first"))
    two = ranked.where("model = 'O'").select("condition", "rank", F.col("pred").alias("second"))
    specialty = F.when(F.col("condition").isin("A", "R"), "x").otherwise("y")
    return one.join(two, ["condition", "rank"]).select("condition", n64("rank").alias("rank"), "first", "second", specialty.alias("specialty"))


MISFIRES = """c AS (SELECT o_orderpriority AS condition, l_returnflag AS model, p_brand AS pred, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY condition, model ORDER BY n DESC, pred) AS rank FROM c QUALIFY rank <= 5),
w AS (SELECT condition, rank, max(CASE model WHEN 'A' THEN pred END) AS nb, max(CASE model WHEN 'N' THEN pred END) AS rf, max(CASE model WHEN 'R' THEN pred END) AS mlp,
  CASE WHEN condition < '3' THEN 'urgent' ELSE 'other' END AS specialty FROM r GROUP BY condition, rank)"""


def three_models(t: Tables) -> DataFrame:
    """The five most frequent misfires of three models beside each other, with the specialty of the condition."""
    counts = t.lineitem.groupBy("l_orderkey", "l_partkey", F.col("l_returnflag").alias("model")).agg(S.count_rows().alias("n"))
    placed = counts.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    cells = placed.groupBy(F.col("o_orderpriority").alias("condition"), "model", F.col("p_brand").alias("pred")).agg(F.sum("n").alias("n"))
    ranked = V.ranked_misfires(cells, ["condition", "model"], 5)
    models = {"A": "nb", "N": "rf", "R": "mlp"}
    wide = ranked.groupBy("condition", n64("rank").alias("rank")).pivot("model", list(models)).agg(F.first("pred"))
    return wide.withColumnsRenamed(models).withColumn("specialty", F.when(F.col("condition") < "3", "urgent").otherwise("other"))


@query("n22_three_models", f"WITH {MISFIRES} SELECT condition, rank, nb, rf, mlp, specialty FROM w")
def n22_three(t: Tables) -> DataFrame:
    return three_models(t).select("condition", "rank", "nb", "rf", "mlp", "specialty")


@query("n22_specialty_outputs", f"WITH {MISFIRES} SELECT specialty, condition, rank, nb, rf, mlp FROM w")
def n22_outputs(t: Tables) -> DataFrame:
    """One report a specialty, written apart and read back with the name of its folder."""
    path = scratch_path(t.spark, "specialties")
    write_partitioned(three_models(t), ["specialty"], path)
    back = t.spark.read.schema("condition string, rank bigint, nb string, rf string, mlp string, specialty string").parquet(path)
    return back.select("specialty", "condition", "rank", "nb", "rf", "mlp")
