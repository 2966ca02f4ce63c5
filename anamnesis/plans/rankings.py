"""Ranks, first rows, top-k, forward fill, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import maths as M
from ..operators import distances as D
from ..operators import ordering as O
from ..operators import rates as B
from ..operators import records as R
from ..operators import splits as G
from ..operators.sizes import settle
from . import roles as S
from .registry import Tables, query
from .roles import n64, r6


@query(
    "e1_rank_top5",
    """WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS label FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS rank FROM f)
SELECT vec_id, rank, CAST(label AS BIGINT) AS label, round(p, 6) AS p FROM r WHERE rank <= 5""",
)
def e1(t: Tables) -> DataFrame:
    top = t.embeddings.select("vec_id", M.ranked(F.col("embedding").cast("array<double>"), 5).alias("top"))
    flat = top.select("vec_id", F.posexplode("top"))
    return flat.select("vec_id", n64(F.col("pos") + 1).alias("rank"), n64("col.label").alias("label"), F.round("col.p", 6).alias("p"))


@query(
    "e2_first_row",
    """SELECT o_custkey AS patient, min(o_orderkey) AS first_id, arg_min(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1""",
)
def e2(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("patient")).agg(
        F.min("o_orderkey").alias("first_id"), F.min_by("o_orderpriority", "o_orderkey").alias("label")
    )


HEAD = """WITH r AS (SELECT o_orderkey AS row_id, o_orderpriority AS label, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)"""


@query("e3_first_n_per_class", f"{HEAD} SELECT row_id, label, CASE WHEN rn <= 100 THEN 'train' ELSE 'validation' END AS split FROM r")
def e3(t: Tables) -> DataFrame:
    return G.first_per_class(S.conditions(t).select("row_id", "label"), "label", "row_id", 100).select("row_id", "label", "split")


@query("e4_head_share", f"{HEAD} SELECT row_id, label, CASE WHEN rn <= ceil(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r")
def e4(t: Tables) -> DataFrame:
    return G.head_split(S.conditions(t).select("row_id", "label"), "label", "row_id", 0.8).select("row_id", "label", "split")


@query(
    "e5_top_bottom_classes",
    """WITH s AS (SELECT l_suppkey AS label, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'top' AS side, label, n::DOUBLE AS n FROM (SELECT * FROM s ORDER BY n DESC, label LIMIT 10)
UNION ALL SELECT 'bottom', label, n::DOUBLE FROM (SELECT * FROM s ORDER BY n, label LIMIT 10)
UNION ALL SELECT 'median', NULL, median(n) FROM s""",
)
def e5(t: Tables) -> DataFrame:
    sizes = settle(t.lineitem.groupBy(F.col("l_suppkey").alias("label")).agg(S.count_rows().alias("n")))
    shape = [F.col("label"), F.col("n").cast("double").alias("n")]
    top = sizes.orderBy(F.desc("n"), "label").limit(10).select(F.lit("top").alias("side"), *shape)
    low = sizes.orderBy("n", "label").limit(10).select(F.lit("bottom").alias("side"), *shape)
    mid = sizes.agg(F.median("n").alias("n")).select(F.lit("median").alias("side"), F.lit(None).cast("bigint").alias("label"), "n")
    return top.unionByName(low).unionByName(mid)


@query(
    "e6_forward_fill",
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""",
)
def e6(t: Tables) -> DataFrame:
    heads = t.events.select("event_id", F.when(F.col("event_type") == "signup", F.col("user_id")).alias("head"))
    return O.forward_fill(heads, "event_id", ["head"]).select("event_id", F.col("head_filled").alias("section"))


@query("e7_dictionary_numbers", f"WITH {S.DIC} SELECT code, CAST(idx AS BIGINT) AS idx FROM dic")
def e7(t: Tables) -> DataFrame:
    return S.dictionary(t).select("code", n64("idx").alias("idx"))


@query(
    "e8_labels_by_frequency",
    """SELECT code, n, row_number() OVER (ORDER BY n DESC, code) - 1 AS idx FROM (SELECT p_name AS code, count(*) AS n FROM part GROUP BY 1) QUALIFY idx < 10""",
)
def e8(t: Tables) -> DataFrame:
    return R.number_by_frequency(t.part, "p_name", 10).select("code", "n", n64("idx").alias("idx"))


@query(
    "e9_difference_to_first",
    """WITH y AS (SELECT o_orderstatus AS model, year(o_orderdate) AS step, avg(o_totalprice) AS score FROM orders GROUP BY ALL)
SELECT model, step, round(abs(score - first_value(score) OVER (PARTITION BY model ORDER BY step)), 6) AS diff FROM y""",
)
def e9(t: Tables) -> DataFrame:
    runs = t.orders.groupBy(F.col("o_orderstatus").alias("model"), F.year("o_orderdate").cast("bigint").alias("step")).agg(
        F.avg("o_totalprice").alias("score")
    )
    first = F.first("score").over(Window.partitionBy("model").orderBy("step"))
    return runs.select("model", "step", F.round(F.abs(F.col("score") - first), 6).alias("diff"))


@query(
    "e10_confused_classes",
    """WITH c AS (SELECT l_returnflag || l_linestatus AS truth, p_type AS pred, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred) AS rank FROM c) SELECT truth, pred, n, rank FROM r WHERE rank BETWEEN 2 AND 6""",
)
def e10(t: Tables) -> DataFrame:
    cells = (
        t.lineitem.groupBy("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("truth"))
        .agg(S.count_rows().alias("n"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("truth", F.col("p_type").alias("pred"))
        .agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("truth").orderBy(F.desc("n"), "pred"))
    return cells.withColumn("rank", n64(rank)).where(F.col("rank").between(2, 6))


@query(
    "e11_nearest_classes",
    f"""{S.BASE}, cls AS (SELECT nation, count(*) AS n FROM rec GROUP BY 1), p AS (SELECT nation, code, count(*) / any_value(n) AS p FROM rec JOIN sym USING (row_id) JOIN cls USING (nation) GROUP BY 1, 2),
nrm AS (SELECT nation, sqrt(sum(p * p)) AS l FROM p GROUP BY 1),
d AS (SELECT b.nation AS other, 1 - sum(a.p * b.p) / any_value(x.l) / any_value(y.l) AS dist FROM p a JOIN p b USING (code) JOIN nrm x ON x.nation = a.nation JOIN nrm y ON y.nation = b.nation WHERE a.nation = 0 AND b.nation <> 0 GROUP BY 1)
SELECT CAST(other AS BIGINT) AS other, round(dist, 6) AS dist FROM d ORDER BY dist, other LIMIT 5""",
)
def e11(t: Tables) -> DataFrame:
    rates = B.class_rates(S.records(t), "nation", "codes")
    near = D.distances_to(rates, "nation", "code", "rate", 0)
    return near.orderBy("cosine", "other").limit(5).select(n64("other").alias("other"), r6(F.col("cosine")).alias("dist"))


@query(
    "e12_next_absent",
    """WITH f AS (SELECT p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
have AS (SELECT DISTINCT p_name FROM part WHERE p_type = 'PROMO' AND p_size > 48)
SELECT p_name AS item, n FROM f WHERE p_name NOT IN (SELECT p_name FROM have) ORDER BY n DESC, item LIMIT 5""",
)
def e12(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_partkey").agg(S.count_rows().alias("n"))
    named = counts.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_name").agg(F.sum("n").alias("n"))
    have = t.part.where((F.col("p_type") == "PROMO") & (F.col("p_size") > 48)).select("p_name")
    return named.join(have, "p_name", "left_anti").orderBy(F.desc("n"), "p_name").limit(5).select(F.col("p_name").alias("item"), "n")


@query("e13_classes_by_size", "SELECT o_custkey AS label, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, label")
def e13(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("label")).agg(S.count_rows().alias("n")).orderBy(F.desc("n"), "label")


@query(
    "e14_argmax",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS label FROM embeddings""",
)
def e14(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", n64(F.array_position("embedding", F.array_max("embedding")) - 1).alias("label"))


@query(
    "e15_variants_by_distance",
    """WITH m AS (SELECT year(o_orderdate) AS variant, avg(o_totalprice) AS acc, avg(o_custkey) AS dist FROM orders GROUP BY 1)
SELECT variant, round(acc, 6) AS acc, row_number() OVER (ORDER BY dist, variant) AS pos FROM m""",
)
def e15(t: Tables) -> DataFrame:
    runs = t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("variant")).agg(
        F.avg("o_totalprice").alias("acc"), F.avg("o_custkey").alias("dist")
    )
    # One row per variant.
    return runs.select("variant", F.round("acc", 6).alias("acc"), n64(F.row_number().over(Window.orderBy("dist", "variant"))).alias("pos"))


@query(
    "e16_feature_offsets",
    """WITH s AS (SELECT p_type AS field, count(DISTINCT p_brand) AS width FROM part GROUP BY 1),
c AS (SELECT field, width, sum(width) OVER (ORDER BY field) AS upto, row_number() OVER (ORDER BY field DESC) AS back FROM s)
SELECT field, CAST(upto AS BIGINT) AS upto FROM c WHERE back > 1""",
)
def e16(t: Tables) -> DataFrame:
    widths = t.part.groupBy(F.col("p_type").alias("field")).agg(F.count_distinct("p_brand").alias("width"))
    # One row per field of the feature vector.
    by_field = Window.orderBy("field")
    upto = F.sum("width").over(by_field.rowsBetween(Window.unboundedPreceding, 0))
    back = F.row_number().over(Window.orderBy(F.desc("field")))
    return widths.select("field", n64(upto).alias("upto"), back.alias("back")).where("back > 1").drop("back")
