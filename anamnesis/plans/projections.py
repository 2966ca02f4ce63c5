"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import aggregates as A
from ..operators import ordering as O
from ..operators import records as R
from ..operators import scores as K
from . import roles as S
from .registry import Tables, query
from .roles import n64, r6


@query("b1_select_reorder", "SELECT o_orderpriority AS label, o_orderkey AS row_id, o_totalprice AS price FROM orders")
def b1(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"))


@query("b2_drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def b2(t: Tables) -> DataFrame:
    return t.customer.drop("c_name", "c_acctbal")


@query("b3_rename", "SELECT n_nationkey AS code, n_name AS nb_name, n_regionkey AS nb_region FROM nation")
def b3(t: Tables) -> DataFrame:
    return t.nation.withColumnsRenamed({"n_nationkey": "code", "n_name": "nb_name", "n_regionkey": "nb_region"})


@query("b4_with_symptoms", f"{S.BASE} SELECT row_id, label FROM rec WHERE len(codes) > 0")
def b4(t: Tables) -> DataFrame:
    return S.reported(t).select("row_id", "label")


@query("b5_membership", "SELECT p_partkey AS item, p_brand AS code FROM part WHERE p_brand IN ('Brand#3', 'Brand#7', 'Brand#11')")
def b5(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_brand").isin("Brand#3", "Brand#7", "Brand#11")).select(
        F.col("p_partkey").alias("item"), F.col("p_brand").alias("code")
    )


@query("b6_equality", "SELECT o_orderkey AS row_id FROM orders WHERE o_orderpriority = '2-HIGH'")
def b6(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority") == "2-HIGH").select(F.col("o_orderkey").alias("row_id"))


@query("b7_code_shape", "SELECT p_partkey AS item, p_brand AS code FROM part WHERE length(p_brand) = 8")
def b7(t: Tables) -> DataFrame:
    return t.part.where(F.length("p_brand") == 8).select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("code"))


@query(
    "b8_class_size_bands",
    """WITH s AS (SELECT l_suppkey AS label, count(*) AS n FROM lineitem GROUP BY 1)
SELECT label, n, CAST(floor((n - (SELECT avg(n) FROM s)) / (SELECT stddev_samp(n) FROM s)) AS BIGINT) AS band FROM s""",
)
def b8(t: Tables) -> DataFrame:
    return A.size_bands(t.lineitem.select(F.col("l_suppkey").alias("label")), "label")


@query(
    "b9_date_order",
    """SELECT l_orderkey AS row_id, CAST(l_linenumber AS BIGINT) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate""",
)
def b9(t: Tables) -> DataFrame:
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.where(F.col("l_shipdate") >= F.col("o_orderdate")).select(F.col("l_orderkey").alias("row_id"), n64("l_linenumber").alias("line"))


@query(
    "b10_null_profile",
    """WITH j AS (SELECT o_orderkey, l_orderkey, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)
SELECT count(*) AS n, count(l_orderkey) AS present, count(*) FILTER (WHERE l_quantity IS NULL) AS missing FROM j""",
)
def b10(t: Tables) -> DataFrame:
    both = R.fan_out(t.orders, t.lineitem, "o_orderkey", "l_orderkey")
    return both.agg(
        S.count_rows().alias("n"), F.count("l_orderkey").alias("present"), F.count_if(F.col("l_quantity").isNull()).alias("missing")
    )


@query(
    "b11_drop_sparse_columns",
    """SELECT l_returnflag, count(CASE WHEN p_size > 25 THEN 1 END) AS large FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def b11(t: Tables) -> DataFrame:
    wide = (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_returnflag")
        .agg(F.count(F.when(F.col("p_size") > 25, 1)).alias("large"), F.max(F.when(F.col("p_size") > 99, 1)).alias("never"))
    )
    return wide.drop(*R.sparse_columns(wide, ["large", "never"], 1))


@query("b12_cast", "SELECT o_orderkey AS row_id, CAST(trunc(o_totalprice) AS INTEGER) AS price, CAST(o_custkey AS VARCHAR) AS cust FROM orders")
def b12(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").cast("int").alias("price"), F.col("o_custkey").cast("string").alias("cust")
    )


@query(
    "b13_within_one_percent",
    """WITH m AS (SELECT l_suppkey AS run, avg(l_extendedprice) AS acc FROM lineitem GROUP BY 1)
SELECT run, round(acc, 6) AS acc FROM m WHERE acc >= (SELECT max(acc) FROM m) * (1 - 0.05::DOUBLE)""",
)
def b13(t: Tables) -> DataFrame:
    runs = t.lineitem.groupBy(F.col("l_suppkey").alias("run")).agg(F.avg("l_extendedprice").alias("acc"))
    return K.near_best(runs, "acc", 0.05).select("run", F.round("acc", 6).alias("acc"))


SAMPLE_SQL = """WITH h AS (SELECT o_orderpriority AS label, o_orderkey AS row_id, md5(concat_ws('-', '5', o_orderkey::VARCHAR)) AS k FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM h)
SELECT label, row_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS pos FROM s WHERE rn <= round(n * 0.05::DOUBLE)) WHERE pos <= 5"""


@query("b14_sample_head", SAMPLE_SQL)
def b14(t: Tables) -> DataFrame:
    rows = S.conditions(t).select("label", "row_id")
    sample = O.hash_rank(rows, ["label"], 5, ["row_id"]).where(F.col("rn") <= F.round(F.col("n") * 0.05))
    # Spark cuts a row_number() <= k filter on the map side before the shuffle.
    pos = F.row_number().over(Window.partitionBy("label").orderBy("row_id"))
    return sample.withColumn("pos", pos).where(F.col("pos") <= 5).select("label", "row_id")


@query(
    "b15_few_symptoms_share",
    f"""{S.BASE} SELECT label, round(avg(CASE WHEN len(codes) < 3 THEN 1.0 ELSE 0.0 END), 6) AS share FROM rec WHERE len(codes) > 0 GROUP BY label""",
)
def b15(t: Tables) -> DataFrame:
    return S.reported(t).groupBy("label").agg(r6(F.avg((F.size("codes") < 3).cast("double"))).alias("share"))


@query(
    "b16_value_gate",
    r"""SELECT page_id, slug, num FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]*/([a-z]+)/([0-9]+)', 1) AS slug,
  TRY_CAST(regexp_extract(url, '^https?://[^/]*/([a-z]+)/([0-9]+)', 2) AS INTEGER) AS num FROM pages) WHERE num IS NOT NULL AND slug <> ''""",
)
def b16(t: Tables) -> DataFrame:
    pattern = r"^https?://[^/]*/([a-z]+)/([0-9]+)"
    parsed = t.pages.where(F.col("url").rlike(pattern)).select(
        "page_id",
        F.regexp_extract("url", pattern, 1).alias("slug"),
        F.regexp_extract("url", pattern, 2).try_cast("int").alias("num"),
    )
    return parsed.where(F.col("num").isNotNull())
