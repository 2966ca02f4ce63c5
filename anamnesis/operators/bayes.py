"""Naive Bayes over symptom tokens and numbers: counts, fit, scores, merge, store.

A row is described by an array of tokens (symptom codes, ``gender``, ``race_2``, ``code|value``)
and by numeric columns. Fitting is two aggregations; the result is two small tables, classes and
weights, so a score is  base(class) + sum of weight(class, token) + the Gaussian terms.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .scoring import score_batch
from .sizes import settle

# Smoothing of the library classifiers and clamp of the hand-written one.
ALPHA = 1.0
CLAMP = 0.001
VAR_SMOOTHING = 1e-9
# Classes x tokens of a block (8 bytes each); one class at least.
BLOCK_CELLS = 4_000_000


@dataclass(frozen=True)
class BayesSpec:
    """How to fit.

    ``smoothing``  ``laplace``: (hits + alpha) / (n + 2 alpha); ``clamp``: hits / n kept in [eps, 1 - eps]
    ``prior``      ``per_component``: the class prior counts once per part of the model (as when the
                   joint log-likelihoods of separately fitted parts are summed); ``once``; ``uniform``
    ``components`` number of parts; tokens and numbers are one each, a single-column multinomial
                   part adds one more (its likelihood is 1, so only its prior shows)
    """

    smoothing: str = "laplace"
    alpha: float = ALPHA
    eps: float = CLAMP
    prior: str = "per_component"
    components: int = 2


def token_counts(rows: DataFrame, label: str, tokens: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., label, token, hits); the NULL token counts the rows of the class."""
    marker = F.array(F.lit(None).cast("string"))
    flat = rows.select(
        *keys, F.col(label).cast("string").alias("label"), F.explode(F.concat(marker, F.array_distinct(tokens))).alias("token")
    )
    return flat.groupBy(*keys, "label", "token").agg(F.count(F.lit(1)).alias("hits"))


def statistics(
    rows: DataFrame, label: str, tokens: str, numbers: Sequence[str], keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame | None]:
    """Count and moment tables from one pass over the rows.

    A NULL token marks the row itself; the numbers are only taken up there. The result (classes x
    tokens rows) is written once, and both tables read it.
    """
    marker = F.array(F.lit(None).cast("string"))
    flat = rows.select(
        *keys,
        F.col(label).cast("string").alias("label"),
        *[F.col(c).cast("double").alias(c) for c in numbers],
        F.explode(F.concat(marker, F.array_distinct(tokens))).alias("token"),
    )
    picks = []
    for c in numbers:
        x = F.when(F.col("token").isNull(), F.col(c))
        picks += [F.count(x).alias(f"_n_{c}"), F.avg(x).alias(f"_m_{c}"), F.var_pop(x).alias(f"_v_{c}")]
    sums = settle(flat.groupBy(*keys, "label", "token").agg(F.count(F.lit(1)).alias("hits"), *picks))
    counts = sums.select(*keys, "label", "token", "hits")
    if not numbers:
        return counts, None
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"_n_{c}").alias("n"),
                F.col(f"_m_{c}").alias("mean"),
                (F.col(f"_v_{c}") * F.col(f"_n_{c}")).alias("m2"),
            )
            for c in numbers
        ]
    )
    stats = sums.where(F.col("token").isNull()).select(*keys, "label", F.explode(items).alias("i")).select(*keys, "label", "i.*")
    return counts, stats.where(F.col("n") > 0)


def merge_counts(parts: Iterable[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Sum of count tables of disjoint row sets."""
    return _union(parts).groupBy(*keys, "label", "token").agg(F.sum("hits").alias("hits"))


def merge_moments(parts: Iterable[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Moments of the union of disjoint row sets."""
    n, mean = F.col("n"), F.col("mean")
    sums = _union(parts).groupBy(*keys, "label", "feature").agg(
        F.sum("n").alias("n"), F.sum(n * mean).alias("s"), (F.sum("m2") + F.sum(n * mean * mean)).alias("q")
    )
    return sums.select(*keys, "label", "feature", "n", (F.col("s") / n).alias("mean"), (F.col("q") - F.col("s") * F.col("s") / n).alias("m2"))


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    first, *rest = list(parts)
    for part in rest:
        first = first.unionByName(part)
    return first


@dataclass(frozen=True)
class BayesModel:
    """``classes`` (label, n, base, rest, words), ``weights`` (label, token, w), ``gauss`` (label, feature, mean, var).

    ``words`` is the size of the dictionary, ``rest`` the weight of a dictionary token the class has no row of in ``weights``.
    A composed model has a dictionary with the ``part`` of each token, and ``rests`` (label, part, rest) in place of one rest a class.
    With ``keys`` the tables hold one model per key (fold, training size); a row is scored by the
    model its own key columns name.
    """

    classes: DataFrame
    weights: DataFrame
    gauss: DataFrame
    dictionary: DataFrame
    numbers: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    rests: DataFrame | None = None
    _sent: list = field(default_factory=list, repr=False, compare=False)

    # -- storage ------------------------------------------------------------------------

    def tables(self) -> dict[str, DataFrame]:
        found = {"classes": self.classes, "weights": self.weights, "gauss": self.gauss, "dictionary": self.dictionary}
        return found | ({"rests": self.rests} if self.rests is not None else {})

    def save(self, path: str) -> None:
        """All tables, and a line that names them with the numbers and keys."""
        spark = self.classes.sparkSession
        for name, table in self.tables().items():
            table.write.mode("errorifexists").parquet(f"{path}/{name}")
        about = json.dumps({"tables": list(self.tables()), "numbers": list(self.numbers), "keys": list(self.keys)})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BayesModel:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in about["tables"]}
        return BayesModel(**tables, numbers=tuple(about["numbers"]), keys=tuple(about["keys"]))

    def of_key(self, **values: object) -> BayesModel:
        """The model of one key: keep the fold that did best."""
        if set(values) != set(self.keys):
            raise ValueError(f"name a value for each of {self.keys}")

        def picked(table: DataFrame) -> DataFrame:
            for k, v in values.items():
                table = table.where(F.col(k).eqNullSafe(F.lit(v)))
            return table.drop(*values)

        rests = None if self.rests is None else picked(self.rests)
        return BayesModel(picked(self.classes), picked(self.weights), picked(self.gauss), self.dictionary, self.numbers, (), rests)

    # -- scoring ------------------------------------------------------------------------

    def score(self, rows: DataFrame, tokens: str, top: int = 5, label: str | None = None) -> DataFrame:
        """Add ``top``: array of (label, p) by falling p, ties by label; ``own``: p of the row's label.

        The model goes to the executors in blocks of classes, and rows are scored where they lie, without a shuffle;
        the answers do not depend on the size of the blocks. Row keys do not matter, so rows may repeat. A row whose model
        key no model has is an error.
        """
        own = F.col(label).cast("string") if label else F.lit(None).cast("string")
        scored = rows.withColumn("_s", self._scorer("top array<struct<label:string,p:double>>, own double", top)(*self._inputs(tokens), own))
        return scored.withColumns({"top": F.col("_s.top"), "own": F.col("_s.own") if label else F.lit(None).cast("double")}).drop("_s")

    def log_probabilities(self, rows: DataFrame, tokens: str) -> DataFrame:
        """Add ``log_p``: array of (label, log_p) of every class in label order."""
        score = self._scorer("array<struct<label:string,log_p:double>>", None)
        return rows.withColumn("log_p", score(*self._inputs(tokens), F.lit(None).cast("string")))

    def _inputs(self, tokens: str) -> list[Column]:
        which = F.concat_ws("|", *[F.col(k).cast("string") for k in self.keys])
        values = F.array(*[F.col(c).cast("double") for c in self.numbers]) if self.numbers else F.array().cast("array<double>")
        return [which, F.array_distinct(tokens), values]

    def _scorer(self, returns: str, top: int | None):
        blocks = self.send()

        @F.arrow_udf(returns)
        def score(which: pa.Array, words: pa.Array, numbers: pa.Array, own: pa.Array) -> pa.Array:
            return score_batch(blocks, which, words, numbers, own, top)

        return score

    def send(self) -> list:
        """Build the model and send it to the executors, once: broadcasts of {key: classes, matrix, moments}, made one after the other; each has BLOCK_CELLS cells or one class."""
        if self._sent:
            return self._sent
        context = self.classes.sparkSession.sparkContext
        listed = self._named(self.classes).select("which", "label", "words").toArrow().sort_by([("which", "ascending"), ("label", "ascending")])
        cells = np.maximum(1, listed["words"].to_numpy())
        block, number, held = [], 0, 0
        for n in cells.tolist():
            if held and held + n > BLOCK_CELLS:
                number, held = number + 1, 0
            held += n
            block.append(number)
        known = self.dictionary if "part" in self.dictionary.columns else self.dictionary.withColumn("part", F.lit(0))
        words = known.select("token", F.col("part").cast("bigint").alias("part")).toArrow().sort_by("token")
        for i in range(number + 1 if block else 0):
            picked = listed.filter(pa.array(np.array(block) == i)).select(["which", "label"])
            self._sent.append(context.broadcast(self._matrices(words, picked if number else None)))
        return self._sent

    def _named(self, table: DataFrame) -> DataFrame:
        return table.withColumn("which", F.concat_ws("|", *[F.col(k).cast("string") for k in self.keys]))

    def _matrices(self, known: pa.Table, picked: pa.Table | None) -> dict[str, dict]:
        """Dense form of the picked classes, or of all; one job brings all tables."""
        words, part_of = known["token"].combine_chunks(), known["part"].to_numpy()
        rests = self.classes.withColumn("part", F.lit(0)) if self.rests is None else self.rests

        def part(kind: str, table: DataFrame, name, x, y) -> DataFrame:
            columns = [F.lit(kind).alias("kind"), F.col("which"), F.col("label")]
            for alias, value, cast in (("name", name, "string"), ("x", x, "double"), ("y", y, "double")):
                columns.append((F.col(value) if value else F.lit(None)).cast(cast).alias(alias))
            return self._named(table).select(*columns)

        table = _union([part("class", self.classes, None, "base", None), part("rest", rests, "part", "rest", None), part("weight", self.weights, "token", "w", None), part("gauss", self.gauss, "feature", "mean", "var")])
        if picked is not None:
            # At most the classes of a block.
            wanted = self.classes.sparkSession.createDataFrame(picked)
            same = (F.col("which") == F.col("_which")) & F.col("label").eqNullSafe(F.col("_label"))
            table = table.join(F.broadcast(wanted.toDF("_which", "_label")), same, "left_semi")
        table = table.toArrow()
        dense = {}
        for name in pc.unique(table["which"]).to_pylist():
            own = table.filter(pc.equal(table["which"], name))
            kinds = {kind: own.filter(pc.equal(own["kind"], kind)) for kind in ("class", "rest", "weight", "gauss")}
            classes = kinds["class"].sort_by("label")
            if not len(classes):
                continue
            labels = classes["label"].combine_chunks()
            rest = np.zeros((int(part_of.max(initial=0)) + 1, len(labels)))
            rest[pc.cast(kinds["rest"]["name"], pa.int64()).to_numpy(), pc.index_in(kinds["rest"]["label"], value_set=labels).to_numpy()] = kinds["rest"]["x"].to_numpy()
            matrix = rest[part_of] if len(words) else np.zeros((1, len(labels)))
            token = pc.index_in(kinds["weight"]["name"], value_set=words).fill_null(-1).to_numpy()
            owner = pc.index_in(kinds["weight"]["label"], value_set=labels).to_numpy()
            known = token >= 0
            matrix[token[known], owner[known]] = kinds["weight"]["x"].to_numpy()[known]
            mean, var = np.zeros((len(self.numbers), len(labels))), np.ones((len(self.numbers), len(labels)))
            for j, number in enumerate(self.numbers):
                stats = kinds["gauss"].filter(pc.equal(kinds["gauss"]["name"], number))
                at = pc.index_in(stats["label"], value_set=labels).to_numpy()
                mean[j, at], var[j, at] = stats["x"].to_numpy(), stats["y"].to_numpy()
            dense[name] = {"labels": labels.to_pylist(), "words": words, "base": classes["x"].to_numpy(), "matrix": matrix, "mean": mean, "var": var}
        return dense


def fit_counts(
    counts: DataFrame,
    stats: DataFrame | None,
    dictionary: DataFrame,
    numbers: Sequence[str] = (),
    spec: BayesSpec = BayesSpec(),
    keys: Sequence[str] = (),
) -> BayesModel:
    """Model from count and moment tables; ``dictionary`` (token) is the feature set.

    Both tables have classes x tokens rows; the facts are not read again.
    """
    dictionary = dictionary.select("token").distinct()
    words = dictionary.agg(F.count(F.lit(1))).scalar()
    on = [*keys, "label"]
    # A window partition holds one class: at most the dictionary and the marker.
    size = F.max(F.when(F.col("token").isNull(), F.col("hits"))).over(Window.partitionBy(*on)).cast("double")
    sized = counts.withColumn("n", size).join(dictionary.withColumn("_in", F.lit(1)), "token", "left")
    seen = sized.where(F.col("_in").isNotNull())
    n, hits = F.col("n"), F.col("hits")
    if spec.smoothing == "clamp":
        p, unseen = F.greatest(F.lit(spec.eps), F.least(F.lit(1 - spec.eps), hits / n)), F.lit(spec.eps)
    else:
        p, unseen = (hits + spec.alpha) / (n + 2 * spec.alpha), F.lit(spec.alpha) / (n + 2 * spec.alpha)
    weights = seen.withColumn("p", p).select(*on, "token", (F.ln("p") - F.ln(1 - F.col("p"))).alias("w"))
    folded = sized.withColumn("p", F.when(F.col("_in").isNotNull(), p)).groupBy(*on).agg(
        F.max("n").alias("n"), F.sum(F.ln(1 - F.col("p"))).alias("_q"), F.count("p").alias("_k")
    )
    classes = folded.withColumn("_u", unseen).withColumn("_all", words)
    total = F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    share = F.ln(n / total) if spec.prior != "uniform" else F.lit(0.0)
    times = spec.components if spec.prior == "per_component" else 1
    base = F.coalesce("_q", F.lit(0.0)) + (F.col("_all") - F.col("_k")) * F.ln(1 - F.col("_u")) + share * F.lit(float(times))
    rest = F.ln("_u") - F.ln(1 - F.col("_u"))
    classes = classes.select(*on, "n", base.alias("base"), rest.alias("rest"), F.col("_all").alias("words"))
    if stats is None or not numbers:
        gauss = _no_numbers(classes, on)
    else:
        gauss = _gaussians(stats, keys)
    return BayesModel(classes, weights, gauss, dictionary, tuple(numbers), tuple(keys))


def _gaussians(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and smoothed population variance per class: the smoothing is a share of the largest overall variance."""
    n, mean = F.col("n"), F.col("mean")
    overall = stats.groupBy(*keys, "feature").agg(
        (F.sum(F.col("m2") + n * mean * mean) / F.sum("n") - F.pow(F.sum(n * mean) / F.sum("n"), F.lit(2))).alias("v")
    )
    extra = overall.groupBy(*keys).agg((F.max("v") * VAR_SMOOTHING).alias("_x"))
    held = stats.join(extra, list(keys)) if keys else stats.withColumn("_x", extra.scalar())
    return held.select(*keys, "label", "feature", "mean", (F.col("m2") / n + F.col("_x")).alias("var"))


def fit(
    rows: DataFrame,
    label: str,
    tokens: str,
    dictionary: DataFrame,
    numbers: Sequence[str] = (),
    spec: BayesSpec = BayesSpec(),
    keys: Sequence[str] = (),
) -> BayesModel:
    counts, stats = statistics(rows, label, tokens, numbers, keys)
    return fit_counts(counts, stats, dictionary, numbers, spec, keys)


def fit_multinomial(counts: DataFrame, dictionary: DataFrame, spec: BayesSpec = BayesSpec(components=1)) -> BayesModel:
    """Model from a count table of tokens as draws from one distribution a class (a category written one-hot): a token that is there adds
    ln((hits + alpha) / (all hits + alpha x words)), one that is not adds nothing.
    """
    dictionary = settle(dictionary.select("token").distinct())
    words = dictionary.agg(F.count(F.lit(1))).scalar()
    counts = settle(counts.select("label", "token", "hits").join(dictionary.withColumn("_in", F.lit(True)), "token", "left"))
    sized = counts.groupBy("label").agg(
        F.max(F.when(F.col("token").isNull(), F.col("hits"))).cast("double").alias("n"), F.coalesce(F.sum(F.when(F.col("_in"), F.col("hits"))), F.lit(0)).alias("_all")
    )
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    share = F.lit(0.0) if spec.prior == "uniform" else F.ln(F.col("n") / total) * F.lit(float(spec.components if spec.prior == "per_component" else 1))
    below = F.col("_all") + words * F.lit(spec.alpha)
    classes = settle(sized.select("label", "n", share.alias("base"), F.ln(F.lit(spec.alpha) / below).alias("rest"), words.alias("words"), below.alias("_below")))
    seen = _null_safe(counts.where("_in"), classes.select("label", "_below"), ["label"])
    weights = seen.select("label", "token", F.ln((F.col("hits") + spec.alpha) / F.col("_below")).alias("w"))
    return BayesModel(classes.drop("_below"), weights, _no_numbers(classes), dictionary)


def compose(*parts: BayesModel) -> BayesModel:
    """The model whose joint log-likelihood is the sum of those of its parts.

    The parts are fitted on the same rows, each with tokens and numbers of its own; a prior counts in every part that
    has one. A class that one of the parts does not have is an error.
    """
    first = parts[0]
    numbers = [n for part in parts for n in part.numbers]
    if any(part.keys != first.keys for part in parts) or len(set(numbers)) < len(numbers):
        raise ValueError("parts need the same keys, and numbers of their own")
    if any(part.rests is not None for part in parts):
        raise ValueError("compose all parts at once")
    on = [*first.keys, "label"]
    classes = _union([part.classes.select(*on, "n", "base", "words", F.lit(i).alias("_part")) for i, part in enumerate(parts)])
    # In the order of the parts, so that the sum has the same bits everywhere.
    bases = [F.max(F.when(F.col("_part") == i, F.col("base"))) for i in range(len(parts))]
    whole = sum(bases[1:], bases[0])
    summed = classes.groupBy(*on).agg(F.max("n").alias("n"), whole.alias("base"), F.sum("words").alias("words"))
    checked = F.when(F.col("base").isNotNull(), F.col("base")).otherwise(F.raise_error(F.lit("a part lacks a class")).cast("double"))
    summed = settle(summed.withColumns({"base": checked, "rest": F.lit(0.0)}))
    rests = settle(_union([part.classes.select(*on, F.lit(i).alias("part"), "rest") for i, part in enumerate(parts)]))
    dictionary = settle(_union([part.dictionary.select("token", F.lit(i).alias("part")) for i, part in enumerate(parts)]))
    if not dictionary.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("parts need tokens of their own")
    weights = settle(_union([part.weights.select(*on, "token", "w") for part in parts]))
    gauss = settle(_union([part.gauss.select(*on, "feature", "mean", "var") for part in parts]))
    return BayesModel(summed, weights, gauss, dictionary, tuple(numbers), first.keys, rests)


def _no_numbers(classes: DataFrame, on: Sequence[str] = ("label",)) -> DataFrame:
    return classes.select(*on, F.lit("").alias("feature"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("var")).where(F.lit(False))


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names in which NULL equals NULL; they are taken from the left."""
    renamed = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(renamed, same, how).drop(*[f"_on_{c}" for c in on])


def fit_gaussian(rows: DataFrame, label: str, numbers: Sequence[str], prior: str = "uniform") -> BayesModel:
    """Gaussian part alone."""
    none = rows.sparkSession.createDataFrame([], "token string")
    empty = rows.withColumn("_none", F.array().cast("array<string>"))
    counts, stats = statistics(empty, label, "_none", numbers)
    return fit_counts(counts, stats, none, numbers, BayesSpec(prior=prior, components=1))


def fit_categorical(rows: DataFrame, label: str, tokens: str, spec: BayesSpec = BayesSpec(components=1)) -> BayesModel:
    """Tokens ``symptom|value``: one categorical feature per symptom, absence being a value of its own."""
    counts = settle(token_counts(rows, label, tokens))
    sizes = counts.where(F.col("token").isNull()).select("label", F.col("hits").cast("double").alias("n"))
    seen = counts.where(F.col("token").isNotNull())
    words = settle(seen.select("token").distinct().withColumn("symptom", F.split_part("token", F.lit("|"), F.lit(1))))
    kinds = words.groupBy("symptom").agg((F.count(F.lit(1)) + 1).alias("k"), F.collect_list("token").alias("words"))
    listed = kinds.agg(F.collect_list(F.struct("symptom", "k", "words"))).scalar()
    grid = sizes.select("label", "n", F.explode(listed).alias("s")).select("label", "n", "s.symptom", "s.k", F.explode("s.words").alias("token"))
    full = grid.join(seen, ["label", "token"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    n, k = F.col("n"), F.col("k")
    none = n - F.sum("hits").over(Window.partitionBy("label", "symptom"))
    full = full.withColumn("_p0", (none + spec.alpha) / (n + k * spec.alpha)).withColumn("_p", (F.col("hits") + spec.alpha) / (n + k * spec.alpha))
    full = settle(full.select("label", "n", "symptom", "token", "_p0", (F.ln("_p") - F.ln("_p0")).alias("w")))
    per_symptom = full.groupBy("label", "n", "symptom").agg(F.max("_p0").alias("_p0"))
    base = per_symptom.groupBy("label", "n").agg(F.sum(F.ln("_p0")).alias("_b"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    share = F.lit(0.0) if spec.prior == "uniform" else F.ln(n / total) * F.lit(float(spec.components if spec.prior == "per_component" else 1))
    size = words.agg(F.count(F.lit(1))).scalar()
    classes = base.select("label", "n", (F.col("_b") + share).alias("base"), F.lit(0.0).alias("rest"), size.alias("words"))
    gauss = _no_numbers(classes)
    return BayesModel(settle(classes), full.select("label", "token", "w"), gauss, words.select("token"))


def rule_table(rows: DataFrame, label: str, codes: str) -> DataFrame:
    """(mask, rule, n): the most frequent class of every exact code set, ties by label."""
    mask = F.array_join(F.array_sort(codes), ";")
    counts = rows.groupBy(mask.alias("mask"), F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("mask").agg(F.min_by("_l", F.struct(-F.col("_n"), "_l")).alias("rule"), F.sum("_n").alias("n"))


def bernoulli_tokens(codes: str, flags: dict[str, Column]) -> Column:
    """Codes plus a token for every flag that holds."""
    extra = F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()])
    return F.concat(F.col(codes), F.array_compact(extra))
