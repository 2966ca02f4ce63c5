"""Feature vectors from design rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel, OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from .scores import standardised
from .sizes import settle, small_side


def code_list(dictionary: DataFrame) -> list[str]:
    """The code dictionary in index order; it is the width of the vectors, so it fits the driver."""
    return [r["code"] for r in dictionary.orderBy("idx").select("code").collect()]


def code_vector(rows: DataFrame, codes: str, words: Sequence[str], out: str) -> DataFrame:
    """Sparse 0/1 vector of an array of codes; unknown codes drop out."""
    model = CountVectorizerModel.from_vocabulary(list(words), inputCol=codes, outputCol=out, minTF=1.0)
    return model.setBinary(True).transform(rows)


def sparse_rows(rows: DataFrame, words: Sequence[str], codes: str = "codes", out: str = "features") -> DataFrame:
    """[gender, race, age] ++ codes; an unknown race is 0."""
    work = code_vector(rows, codes, words, "_codes").withColumn("race", F.coalesce("race", F.lit(0)))
    return VectorAssembler(inputCols=["gender", "race", "age", "_codes"], outputCol=out).transform(work).drop("_codes")


def race_vector(rows: DataFrame, column: str = "race", out: str = "_race", width: int = 5) -> DataFrame:
    """One-hot race, code 0 in the first position; all 0 for an unknown one."""
    fixed = OneHotEncoder(inputCols=[column], outputCols=[out], dropLast=True, handleInvalid="keep")
    sample = rows.sparkSession.range(width).select(F.col("id").cast("double").alias(column))
    return fixed.fit(sample).transform(rows.withColumn(column, F.coalesce(F.col(column).cast("double"), F.lit(float(width)))))


def one_hot_rows(rows: DataFrame, words: Sequence[str], scale_age: bool, codes: str = "codes", out: str = "features") -> DataFrame:
    """[age, gender] ++ one-hot race ++ codes, the age as it is or standardised."""
    work = standardised(rows, "age", "_age") if scale_age else rows.withColumn("_age", F.col("age"))
    work = race_vector(code_vector(work, codes, words, "_codes"))
    return VectorAssembler(inputCols=["_age", "gender", "_race", "_codes"], outputCol=out).transform(work).drop("_age", "_race", "_codes")


def valued_rows(rows: DataFrame, values: str, width: int, out: str = "features") -> DataFrame:
    """[gender, race, age] ++ coded values: ``values`` maps an index to its code, 0 where absent."""
    numbers = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(F.col(values), i), F.lit(0)).cast("double")
    )
    work = rows.withColumn("_v", array_to_vector(numbers)).withColumn("race", F.coalesce("race", F.lit(0)))
    return VectorAssembler(inputCols=["gender", "race", "age", "_v"], outputCol=out).transform(work).drop("_v")


def ordinal(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Observed categories numbered from 0 in sorted order."""
    indexer = StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep")
    return indexer.fit(rows).transform(rows).withColumn(out, F.col(out).cast("int"))


def permuted(rows: DataFrame, column: str, first: Sequence[int], width: int, out: str = "permuted") -> DataFrame:
    """Vector with the given positions in front and the rest behind, in order."""
    order = [*first, *[i for i in range(width) if i not in set(first)]]
    return VectorSlicer(inputCol=column, outputCol=out, indices=order).transform(rows)


def nonzero(rows: DataFrame, keys: Sequence[str], column: str = "features") -> DataFrame:
    """(keys..., idx, value) of the nonzero entries."""
    flat = rows.select(*keys, F.posexplode(vector_to_array(column)).alias("idx", "value"))
    return flat.where(F.col("value") != 0)


def nominal(rows: DataFrame, value: str, encoding: DataFrame, default: int, out: str) -> DataFrame:
    """Code of an observed value by a dictionary (value, code); NULL and unknown give ``default``.

    Few values hold most of the rows, so the dictionary is written once and broadcast where its counted size allows.
    """
    coded = settle(encoding.select(F.col("value").alias("_value"), F.col("code").alias("_code")))
    texts = [name for name, kind in coded.dtypes if kind == "string"]
    joined = rows.join(small_side(coded, text_columns=texts), F.col(value) == F.col("_value"), "left")
    return joined.withColumn(out, F.coalesce("_code", F.lit(default))).drop("_value", "_code")


def layout_differences(plain: DataFrame, hot: DataFrame, key: str, width: int) -> DataFrame:
    """Compare [gender, race, age, codes] with [age, gender, race x 5, codes]: differing rows per part."""
    a = plain.select(key, vector_to_array("features").alias("a"))
    b = hot.select(key, vector_to_array("features").alias("b"))
    both = a.join(b, key)
    race = F.aggregate(
        F.slice("b", 3, 5), F.struct(F.lit(0).alias("i"), F.lit(-1).alias("at")),
        lambda s, v: F.struct((s["i"] + 1).alias("i"), F.when(v > 0, s["i"]).otherwise(s["at"]).alias("at")),
        lambda s: s["at"].cast("double"),
    )
    return both.agg(
        F.count_if(F.get("a", 0) != F.get("b", 1)).alias("gender"),
        F.count_if(F.get("a", 2) != F.get("b", 0)).alias("age"),
        F.count_if(F.get("a", 1) != race).alias("race"),
        F.count_if(F.slice("a", 4, width) != F.slice("b", 8, width)).alias("codes"),
        F.count(F.lit(1)).alias("rows"),
    )
