"""User functions of all kinds, pipeline stages, and dataflow control."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..functions import codes as C
from ..operators import estimators as M
from ..operators import folds as K
from ..operators import rates as B
from ..session import scratch_path
from . import roles as S
from .evaluation import PR
from .models import feature_set, nb_sql, training
from .registry import Tables, query
from .roles import n64, r6


@query("u1_scalar_function", "SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS code FROM orders")
def u1(t: Tables) -> DataFrame:
    """A per-value function with its lookup table as an argument, as columns."""
    return t.orders.select(F.col("o_orderkey").alias("row_id"), C.lookup(F.col("o_orderstatus"), {"F": 0, "O": 1}).alias("code"))


@query("u2_parallel_scalar", "SELECT p_partkey AS item, CAST(length(p_name) AS INTEGER) AS n FROM part")
def u2(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("item"), F.length("p_name").alias("n"))


@query("u3_typed_scalar", "SELECT p_partkey AS item, upper(p_name) AS name FROM part")
def u3(t: Tables) -> DataFrame:
    """A user function with a declared type, on Arrow arrays."""

    @F.arrow_udf("string")
    def upper(names: pa.Array) -> pa.Array:
        return pc.utf8_upper(names)

    return t.part.select(F.col("p_partkey").alias("item"), upper("p_name").alias("name"))


@query("u4_row_function", "SELECT o_orderkey AS row_id, o_orderstatus || '/' || o_orderpriority AS tag FROM orders")
def u4(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("row_id"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("tag"))


@query("u5_partition_function", "SELECT l_orderkey AS row_id, CAST(l_linenumber AS BIGINT) AS line, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem")
def u5(t: Tables) -> DataFrame:
    def net(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row_id": batch.l_orderkey, "line": batch.l_linenumber, "net": batch.l_extendedprice * (1 - batch.l_discount)})

    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return K.map_batches(rows, net, "row_id bigint, line bigint, net double").withColumn("net", F.round("net", 6))


@query(
    "u6_grouped_function",
    f"""{S.BASE}, c AS (SELECT label, code, count(*) AS hits FROM rec JOIN sym USING (row_id) GROUP BY ALL)
SELECT label, code, CAST(row_number() OVER (PARTITION BY label ORDER BY hits DESC, code) AS BIGINT) AS rank FROM c""",
)
def u6(t: Tables) -> DataFrame:
    """A function per group, on the pre-aggregated class table: a group has at most the dictionary."""

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["hits", "code"], ascending=[False, True])
        return ordered.assign(rank=range(1, len(ordered) + 1))[["label", "code", "rank"]]

    rates = B.class_rates(S.coded(t), "label", "codes").select("label", "code", "hits")
    return rates.groupBy("label").applyInPandas(rank, "label string, code string, rank bigint")


@query("u7_python_aggregate", "SELECT l_partkey AS item, CAST(bit_or(1 << l_linenumber) AS BIGINT) AS mask FROM lineitem GROUP BY 1")
def u7(t: Tables) -> DataFrame:
    """A Python aggregate over the distinct values of each key; built-in aggregates serve wherever they can."""

    @F.pandas_udf("bigint")
    def mask(lines: pd.Series) -> int:
        return int(np.bitwise_or.reduce(1 << lines.to_numpy(np.int64)))

    rows = t.lineitem.groupBy(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("line")).agg(S.count_rows().alias("n"))
    return rows.groupBy("item").agg(mask("line").alias("mask"))


@query("u8_flattened_lists", f"{S.BASE} SELECT label, code, count(*) AS n FROM rec JOIN sym USING (row_id) GROUP BY ALL")
def u8(t: Tables) -> DataFrame:
    """All lists of a class as one: rows, not one array per class."""
    flat = S.coded(t).select("label", F.explode("codes").alias("code"))
    return flat.groupBy("label", "code").agg(S.count_rows().alias("n"))


@query("u9_estimator_protocol", f"{PR} SELECT row_id, pred AS prediction, round(best, 6) AS p FROM pd")
def u9(t: Tables) -> DataFrame:
    """fit, save, load, transform: the pipeline before the fit and the fitted one go through files."""
    rows = training(t)
    stage = M.CompositeNaiveBayes(labelCol="label", tokensCol="tokens", numberCols=["age"]).setDictionary(feature_set(t))
    raw, fitted = scratch_path(t.spark, "pipeline"), scratch_path(t.spark, "fitted")
    Pipeline(stages=[stage]).save(raw)
    Pipeline.load(raw).fit(rows).save(fitted)
    again = PipelineModel.load(fitted)
    return again.transform(rows).select("row_id", "prediction", r6(F.get("top", 0)["p"]).alias("p"))


@query("u9_class_probabilities", f"{nb_sql(label='label')} SELECT row_id, cand AS label, round(s - lz, 6) AS log_p FROM sc JOIN z USING (row_id)")
def u9_all(t: Tables) -> DataFrame:
    """Every class of every record with the logarithm of its probability."""
    rows = training(t, "label")
    stage = M.CompositeNaiveBayes(labelCol="label", tokensCol="tokens", numberCols=["age"]).setDictionary(feature_set(t))
    flat = stage.fit(rows).logProbabilities(rows).select("row_id", F.explode("log_p").alias("c"))
    return flat.select("row_id", "c.label", r6(F.col("c.log_p")).alias("log_p"))


@query("u10_evaluator", f"{PR} SELECT 5 AS n, round(avg(CASE WHEN own_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS score FROM pd")
def u10(t: Tables) -> DataFrame:
    rows = training(t)
    stage = M.CompositeNaiveBayes(labelCol="label", tokensCol="tokens", numberCols=["age"]).setDictionary(feature_set(t))
    score = M.TopNEvaluator(labelCol="label", n=5).evaluate(stage.fit(rows).transform(rows))
    return t.spark.range(1).select(F.lit(5).alias("n"), F.round(F.lit(score), 6).alias("score"))


@query("u11_rows_from_row", f"{S.BASE} SELECT row_id, unnest(codes) AS code, CAST(generate_subscripts(codes, 1) - 1 AS INTEGER) AS pos FROM rec")
def u11(t: Tables) -> DataFrame:
    return S.coded(t).select("row_id", F.posexplode("codes").alias("pos", "code"))


@query("v1_repartition", "SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def v1(t: Tables) -> DataFrame:
    return t.orders.repartition(16, "o_orderkey").groupBy(F.col("o_orderpriority").alias("label")).agg(S.count_rows().alias("n"))


@query("v2_persist", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part WHERE p_size > 10")
def v2(t: Tables) -> DataFrame:
    """A frame kept for two uses; Spark spills it to disk where memory is short."""
    kept = t.part.where(F.col("p_size") > 10).select("p_size").persist()
    total = kept.agg(F.sum("p_size")).scalar()
    return kept.agg(S.count_rows().alias("n")).withColumn("total", n64(total))


@query(
    "v3_one_pass",
    "SELECT count(*) AS n, round(avg(o_totalprice), 6) AS mean, min(o_orderkey) AS low, max(o_orderkey) AS high, count(DISTINCT o_custkey) AS patients FROM orders",
)
def v3(t: Tables) -> DataFrame:
    return t.orders.agg(
        S.count_rows().alias("n"),
        F.round(F.avg("o_totalprice"), 6).alias("mean"),
        F.min("o_orderkey").alias("low"),
        F.max("o_orderkey").alias("high"),
        F.count_distinct("o_custkey").alias("patients"),
    )


@query("v4_preview", "SELECT o_orderkey AS row_id, o_totalprice AS price FROM orders ORDER BY price DESC, row_id LIMIT 5")
def v4(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"))
