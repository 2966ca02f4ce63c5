"""Cross-validated fits and learning curves of naive Bayes from one count table."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, functions as F

from . import bayes as N
from .evaluation import accuracy
from .ordering import hash_rank
from .sizes import settle, store
from .splits import kfold


def _other_folds(table: DataFrame, folds: int) -> DataFrame:
    """Each fold's rows go to the training tables of all other folds."""
    every = F.sequence(F.lit(0), F.lit(folds - 1))
    return table.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.array_except(every, F.array("_own")))).drop("_own")


def _up_to_level(table: DataFrame, levels: int) -> DataFrame:
    """Rows of a level belong to every training size from that level on."""
    return table.withColumnRenamed("level", "_own").withColumn("level", F.explode(F.sequence("_own", F.lit(levels - 1)))).drop("_own")


def _dealt(rows: DataFrame, label: str, ids: Sequence[str], folds: int, fractions: Sequence[float]) -> DataFrame:
    """Fold and level from one hash rank."""
    ranked = hash_rank(rows, [label], 0, ids)
    level = F.lit(None).cast("int")
    for i in reversed(range(len(fractions))):
        level = F.when(F.col("rn") <= F.round(F.col("n") * fractions[i]), i).otherwise(level)
    return ranked.withColumns({"fold": ((F.col("rn") - 1) % folds).cast("int"), "level": level}).drop("rn", "n")


@dataclass(frozen=True)
class CrossValidation:
    """Rows with their ``fold``, and one model a fold, fitted on the rows of all other folds."""

    rows: DataFrame
    model: N.BayesModel
    label: str
    tokens: str

    def scored(self) -> DataFrame:
        """Rows with ``top`` and ``own``, each scored by the model of the other folds."""
        return self.model.score(self.rows, self.tokens, 5, self.label)

    def fold_scores(self, tops: Sequence[int] = (1, 5)) -> DataFrame:
        return accuracy(self.scored(), self.label, ["fold"], tops)

    def keep_best(self) -> tuple[int, N.BayesModel]:
        """The fold whose model has the highest share of first hits on the rows held out (of equal ones the first), and that model."""
        scores = self.fold_scores((1,)).orderBy(F.desc("top_1"), "fold")
        best = scores.first()["fold"]  # one row a fold
        return best, self.model.of_key(fold=best)


def cross_validation(
    rows: DataFrame, label: str, tokens: str, ids: Sequence[str], dictionary: DataFrame, numbers: Sequence[str], folds: int, spec: N.BayesSpec
) -> CrossValidation:
    """All models come from one count table by fold.

    Sums over the tokens of a class are written once: a kept model has the same bits as the one that was scored.
    """
    dealt = store(kfold(rows, label, ids, folds))
    counts, stats = N.statistics(dealt, label, tokens, numbers, ["fold"])
    counts = settle(N.merge_counts([_other_folds(counts, folds)], ["fold"]))
    stats = settle(N.merge_moments([_other_folds(stats, folds)], ["fold"])) if stats is not None else None
    model = N.fit_counts(counts, stats, dictionary, numbers, spec, ["fold"])
    return CrossValidation(dealt, replace(model, classes=settle(model.classes), gauss=settle(model.gauss)), label, tokens)


def learning_curve(
    rows: DataFrame,
    label: str,
    tokens: str,
    ids: Sequence[str],
    dictionary: DataFrame,
    numbers: Sequence[str],
    fractions: Sequence[float],
    folds: int,
    spec: N.BayesSpec,
) -> DataFrame:
    """(level, fold, role, n, top_1, top_5): scores of every training size and fold on the rows held out (``test``) and trained on (``train``).

    Facts are counted once per (fold, level); the models of the whole grid are sums of those
    counts. A row goes to the models of its own fold at every size, and to those of the other folds at the sizes that it is trained on.
    """
    dealt = store(_dealt(rows, label, ids, folds, fractions))
    keyed = _grid_model(dealt, label, tokens, dictionary, numbers, len(fractions), folds, spec)
    every = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.transform(F.sequence(F.lit(0), F.lit(len(fractions) - 1)), lambda v: F.struct(f.alias("fold"), v.alias("level"))))
    wanted = F.filter(F.flatten(every), lambda g: (g["fold"] == F.col("_fold")) | (g["level"] >= F.col("_level")))
    spread = dealt.withColumnsRenamed({"fold": "_fold", "level": "_level"}).withColumn("_g", F.explode(wanted))
    role = F.when(F.col("_g.fold") == F.col("_fold"), "test").otherwise("train")
    spread = spread.select("*", "_g.fold", "_g.level", role.alias("role")).drop("_g", "_fold", "_level")
    return accuracy(keyed.score(spread, tokens, 5, label), label, ["level", "fold", "role"])


def _grid_model(dealt: DataFrame, label: str, tokens: str, dictionary: DataFrame, numbers: Sequence[str], levels: int, folds: int, spec: N.BayesSpec) -> N.BayesModel:
    counts, stats = N.statistics(dealt, label, tokens, numbers, ["fold", "level"])

    def grid(table: DataFrame) -> DataFrame:
        return _up_to_level(_other_folds(table, folds), levels)

    keys = ["fold", "level"]
    counts, stats = settle(N.merge_counts([grid(counts)], keys)), settle(N.merge_moments([grid(stats)], keys)) if stats is not None else None
    return N.fit_counts(counts, stats, dictionary, numbers, spec, keys)


def curve_times(
    rows: DataFrame,
    label: str,
    tokens: str,
    ids: Sequence[str],
    dictionary: DataFrame,
    numbers: Sequence[str],
    fractions: Sequence[float],
    folds: int,
    spec: N.BayesSpec,
) -> DataFrame:
    """(level, fold, train_n, test_n, fit_seconds, score_seconds): each model of the grid fitted and scored on its own.

    Sizes and folds are few; the rows are counted by the jobs that are timed.
    """
    dealt = store(_dealt(rows, label, ids, folds, fractions))
    found = []
    for level in range(len(fractions)):
        for fold in range(folds):
            trained, scored = Observation(), Observation()
            begin = time.perf_counter()
            part = dealt.where((F.col("fold") != fold) & (F.col("level") <= level)).observe(trained, F.count(F.lit(1)).alias("n"))
            counts, stats = N.statistics(part, label, tokens, numbers)
            model = N.fit_counts(counts, stats, dictionary, numbers, spec)
            model.send()
            fitted = time.perf_counter()
            tests = dealt.where(F.col("fold") == fold).observe(scored, F.count(F.lit(1)).alias("n"))
            model.score(tests, tokens, 5, label).select("top", "own").write.format("noop").mode("overwrite").save()
            found.append((level, fold, trained.get["n"], scored.get["n"], fitted - begin, time.perf_counter() - fitted))
    return rows.sparkSession.createDataFrame(found, "level int, fold int, train_n bigint, test_n bigint, fit_seconds double, score_seconds double")
