"""Forests, boosting and networks on vector columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession, functions as F


def dense_features(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def random_forest(trees: int = 140, depth: int = 30, leaf: int = 2, seed: int = 0, subset: str = "auto") -> RandomForestClassifier:
    """Gini forest; Spark grows trees to a depth of 30 at most."""
    return RandomForestClassifier(
        numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=leaf, featureSubsetStrategy=subset, impurity="gini", seed=seed
    )


def boosted(rounds: int = 20, depth: int = 5, seed: int = 0) -> OneVsRest:
    """One boosted model per class against the rest."""
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed))


def perceptron(layers: Sequence[int], rounds: int = 100, seed: int = 0) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=list(layers), maxIter=rounds, seed=seed, blockSize=128)


def predictions(scored: DataFrame, key: str) -> DataFrame:
    return scored.select(key, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))


def averaged(models: Sequence[Model], rows: DataFrame, key: str) -> DataFrame:
    """Class with the largest mean probability over models grown on different chunks; one pass over the rows."""
    work = rows
    for i, model in enumerate(models):
        work = model.transform(work).withColumn(f"_p{i}", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
    total = F.col("_p0")
    for i in range(1, len(models)):
        total = F.zip_with(total, f"_p{i}", lambda a, b: a + b)
    best = F.array_position(total, F.array_max(total)) - 1
    return work.select(key, F.col("label").cast("int").alias("label"), best.cast("int").alias("pred"))


def importances(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """(feature, importance, rank), largest first."""
    pairs = sorted(zip(model.featureImportances.toArray().tolist(), names), key=lambda x: (-x[0], x[1]))
    return spark.createDataFrame([(n, v, i + 1) for i, (v, n) in enumerate(pairs)], "feature string, importance double, rank int")


def grid_search(rows: DataFrame, grid: Mapping[str, Sequence[object]], train: float = 0.8, parallelism: int = 4, seed: int = 0) -> DataFrame:
    """(parameters, accuracy) of every forest of a grid, each fitted and scored on one split."""
    forest = RandomForestClassifier(seed=seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(forest.getParam(name), list(values))
    maps = builder.build()
    search = TrainValidationSplit(
        estimator=forest,
        estimatorParamMaps=maps,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
        trainRatio=train,
        parallelism=parallelism,
        seed=seed,
    )
    scores = search.fit(rows).validationMetrics
    out = [(" ".join(f"{p.name}_{v}" for p, v in m.items()), float(s)) for m, s in zip(maps, scores)]
    return rows.sparkSession.createDataFrame(out, "name string, accuracy double")


def compress(rows: DataFrame, column: str, width: int, out: str = "latent") -> DataFrame:
    """First ``width`` principal components of a vector column, as an array."""
    model = PCA(k=width, inputCol=column, outputCol="_pca").fit(rows)
    return model.transform(rows).withColumn(out, vector_to_array("_pca")).drop("_pca")
