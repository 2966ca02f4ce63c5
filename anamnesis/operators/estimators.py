"""The naive Bayes model and the top-n score as ``pyspark.ml`` stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bayes as N
from .evaluation import top_hit


class _NaiveBayesParams(HasLabelCol):
    """What the estimator and its model share."""

    tokensCol = Param(Params._dummy(), "tokensCol", "array column of tokens", TypeConverters.toString)
    numberCols = Param(Params._dummy(), "numberCols", "numeric columns", TypeConverters.toListString)
    prior = Param(Params._dummy(), "prior", "per_component, once or uniform", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "smoothing", TypeConverters.toFloat)
    top = Param(Params._dummy(), "top", "number of ranked classes", TypeConverters.toInt)

    def _set_defaults(self) -> None:
        self._setDefault(labelCol="label", tokensCol="tokens", numberCols=[], prior="per_component", alpha=1.0, top=5)


class CompositeNaiveBayes(Estimator, _NaiveBayesParams, MLWritable, MLReadable):
    """Gaussian numbers and Bernoulli tokens; tokens seen in training are the feature set unless one is given."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", tokensCol: str = "tokens", numberCols: Sequence[str] = (), prior: str = "per_component", alpha: float = 1.0, top: int = 5):
        super().__init__()
        self._set_defaults()
        self._set(**self._input_kwargs)
        self.dictionary: DataFrame | None = None

    def setDictionary(self, dictionary: DataFrame) -> CompositeNaiveBayes:
        self.dictionary = dictionary
        return self

    def _fit(self, dataset: DataFrame) -> CompositeNaiveBayesModel:
        label, tokens = self.getOrDefault("labelCol"), self.getOrDefault("tokensCol")
        numbers = self.getOrDefault("numberCols")
        spec = N.BayesSpec(alpha=self.getOrDefault("alpha"), prior=self.getOrDefault("prior"), components=1 + bool(numbers))
        words = self.dictionary
        if words is None:
            words = dataset.select(F.explode(tokens).alias("token")).distinct()
        model = CompositeNaiveBayesModel(N.fit(dataset, label, tokens, words, numbers, spec))
        return self._copyValues(model)

    def write(self) -> MLWriter:
        return _TablesWriter(self, lambda path: self.dictionary is not None and self.dictionary.write.parquet(f"{path}/dictionary"), {"dictionary": self.dictionary is not None})

    @classmethod
    def read(cls) -> MLReader:
        def opened(spark: SparkSession, path: str, about: dict) -> CompositeNaiveBayes:
            stage = cls()
            return stage.setDictionary(spark.read.parquet(f"{path}/dictionary")) if about["dictionary"] else stage

        return _TablesReader(opened)


class CompositeNaiveBayesModel(Model, _NaiveBayesParams, MLWritable, MLReadable):
    """Adds ``top`` (ranked classes with probabilities), ``own`` and ``prediction``.

    It is kept as a ``pyspark.ml`` stage: the parameters beside the tables of the model, alone or within a pipeline.
    """

    def __init__(self, bayes: N.BayesModel):
        super().__init__()
        self._set_defaults()
        self.bayes = bayes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        label = self.getOrDefault("labelCol")
        scored = self.bayes.score(dataset, self.getOrDefault("tokensCol"), self.getOrDefault("top"), label if label in dataset.columns else None)
        return scored.withColumn("prediction", F.get("top", 0)["label"])

    def logProbabilities(self, dataset: DataFrame) -> DataFrame:
        """Add ``log_p``: every class with the logarithm of its probability."""
        return self.bayes.log_probabilities(dataset, self.getOrDefault("tokensCol"))

    def write(self) -> MLWriter:
        return _TablesWriter(self, lambda path: self.bayes.save(f"{path}/bayes"), {})

    @classmethod
    def read(cls) -> MLReader:
        return _TablesReader(lambda spark, path, about: cls(N.BayesModel.load(spark, f"{path}/bayes")))


class _TablesWriter(MLWriter):
    """Parameters as the metadata of the library, tables beside them."""

    def __init__(self, stage: Params, write_tables: Callable[[str], object], about: dict):
        super().__init__()
        self.stage, self.write_tables, self.about = stage, write_tables, about

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"about": self.about})
        self.write_tables(path)


class _TablesReader(MLReader):
    def __init__(self, opened: Callable[[SparkSession, str, dict], Params]):
        super().__init__()
        self.opened = opened

    def load(self, path: str) -> Params:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.opened(self.sparkSession, path, metadata["about"])
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class TopNEvaluator(Evaluator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Share of rows whose label is among the first ``n`` classes (with p > 0 unless switched off)."""

    n = Param(Params._dummy(), "n", "number of classes", TypeConverters.toInt)
    requirePositive = Param(Params._dummy(), "requirePositive", "whether p must be above 0", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", n: int = 5, requirePositive: bool = True):
        super().__init__()
        self._setDefault(labelCol="label", n=5, requirePositive=True)
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        hit = top_hit(self.getOrDefault("labelCol"), self.getOrDefault("n"), self.getOrDefault("requirePositive"))
        return dataset.agg(F.avg(hit.cast("double")).alias("s")).first()["s"]

    def isLargerBetter(self) -> bool:
        return True
