"""Splits, folds, subsamples and source mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import splits as G
from . import roles as S
from .registry import Tables, query
from .roles import n64


def ranked_sql(seed: str, part: str = "label") -> str:
    return f"""WITH h AS (SELECT o_orderkey AS row_id, o_orderpriority AS label, o_orderstatus AS source, md5(concat_ws('-', {seed}, o_orderkey::VARCHAR)) AS k FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY k, row_id) AS rn, count(*) OVER (PARTITION BY {part}) AS n FROM h)"""


def rows(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("source"))


@query(
    "g1_stratified_split",
    f"{ranked_sql(chr(39) + '7' + chr(39))} SELECT row_id, label, CASE WHEN rn <= round(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r",
)
def g1(t: Tables) -> DataFrame:
    return G.stratified_split(rows(t), "label", ["row_id"], 0.8, 7).select("row_id", "label", "split")


@query(
    "g2_ceil_split",
    f"{ranked_sql(chr(39) + '0' + chr(39))} SELECT row_id, CASE WHEN rn <= ceil(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r",
)
def g2(t: Tables) -> DataFrame:
    return G.stratified_split(rows(t), "label", ["row_id"], 0.8, 0, "ceil").select("row_id", "split")


@query(
    "g3_positional_split",
    """WITH r AS (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT row_id, CASE WHEN rn <= floor(n * 70 / 100) THEN 'train' WHEN rn <= floor(n * 70 / 100) + floor(n * 10 / 100) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def g3(t: Tables) -> DataFrame:
    return G.positional_split(rows(t), "row_id").select("row_id", "split")


@query(
    "g4_concat_split",
    """WITH u AS (SELECT o_orderkey AS row_id, o_orderpriority AS label FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('-', '1', row_id::VARCHAR)), row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM u)
SELECT row_id, CASE WHEN rn <= round(n * 0.9::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def g4(t: Tables) -> DataFrame:
    one, two, three = (rows(t).where(F.col("source") == s) for s in ("F", "O", "P"))
    return G.stratified_split(one.unionByName(two).unionByName(three), "label", ["row_id"], 0.9, 1).select("row_id", "split")


@query(
    "g5_learning_fractions",
    f"""{ranked_sql(chr(39) + '3' + chr(39))} SELECT label, CAST(CASE WHEN rn <= round(n * 0.1::DOUBLE) THEN 0 WHEN rn <= round(n * 0.5::DOUBLE) THEN 1 ELSE 2 END AS BIGINT) AS level, count(*) AS n FROM r GROUP BY ALL""",
)
def g5(t: Tables) -> DataFrame:
    levels = G.learning_fractions(rows(t), "label", ["row_id"], [0.1, 0.5, 1.0], 3)
    return levels.groupBy("label", n64("level").alias("level")).agg(S.count_rows().alias("n"))


@query(
    "g6_holdout_folds",
    """WITH h AS (SELECT o_orderkey AS row_id, o_orderpriority AS label, fold, md5(concat_ws('-', 'fold', fold::VARCHAR, o_orderkey::VARCHAR)) AS k FROM orders, range(5) f(fold)),
r AS (SELECT *, row_number() OVER (PARTITION BY label, fold ORDER BY k, row_id) AS rn, count(*) OVER (PARTITION BY label, fold) AS n FROM h)
SELECT row_id, fold, CASE WHEN rn <= round(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def g6(t: Tables) -> DataFrame:
    return G.holdout_folds(rows(t), "label", ["row_id"], 5).select("row_id", n64("fold").alias("fold"), "split")


@query("g7_kfold", f"{ranked_sql(chr(39) + '0' + chr(39))} SELECT row_id, CAST((rn - 1) % 5 AS BIGINT) AS fold FROM r")
def g7(t: Tables) -> DataFrame:
    return G.kfold(rows(t), "label", ["row_id"], 5).select("row_id", n64("fold").alias("fold"))


@query(
    "g8_balanced_classes",
    f"""{ranked_sql(chr(39) + '0' + chr(39))} SELECT row_id, CASE WHEN rn <= floor((SELECT min(n) FROM r) * 0.95::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM r""",
)
def g8(t: Tables) -> DataFrame:
    return G.balance_classes(rows(t), "label", ["row_id"]).select("row_id", "split")


@query(
    "g9_mixed_sources",
    f"""{ranked_sql(chr(39) + '0' + chr(39), 'source, label')} SELECT source, row_id FROM r WHERE rn <= round(n * (CASE source WHEN 'F' THEN 20 ELSE 10 END) / 100)""",
)
def g9(t: Tables) -> DataFrame:
    mixed = G.mix_sources(rows(t), "source", "label", ["row_id"], {"F": 20, "O": 10, "P": 10})
    return mixed.select("source", "row_id")


@query(
    "g10_learning_grid",
    f"""{ranked_sql(chr(39) + '0' + chr(39))}, l AS (SELECT *, (rn - 1) % 3 AS fold, CASE WHEN rn <= round(n * 0.25::DOUBLE) THEN 0 WHEN rn <= round(n * 0.5::DOUBLE) THEN 1 ELSE 2 END AS level FROM r)
SELECT CAST(fold AS BIGINT) AS fold, CAST(level AS BIGINT) AS level, label, count(*) AS n FROM l GROUP BY ALL""",
)
def g10(t: Tables) -> DataFrame:
    """Cells of the grid of folds and training sizes; a size is the sum of the levels up to it."""
    folds = G.kfold(rows(t), "label", ["row_id"], 3)
    grid = G.learning_fractions(folds, "label", ["row_id"], [0.25, 0.5, 1.0])
    return grid.groupBy(n64("fold").alias("fold"), n64("level").alias("level"), "label").agg(S.count_rows().alias("n"))
