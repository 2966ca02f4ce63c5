"""Set operations on rows and on symptom sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import records as R
from . import roles as S
from .registry import Tables, query
from .roles import n64


def two_sql(code: str) -> str:
    return f"""WITH own AS (SELECT DISTINCT o_custkey AS label, o_orderstatus AS source, {code} AS code FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT label, list(code) AS a FROM own WHERE source = 'F' GROUP BY label), o AS (SELECT label, list(code) AS b FROM own WHERE source = 'O' GROUP BY label)"""


TWO, FEW = two_sql("p_brand"), two_sql("p_type")


def two_sets(t: Tables, code: str = "p_brand") -> DataFrame:
    """Per customer the codes of two sources that have some: (label, a, b)."""
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    flat = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sides = flat.groupBy(F.col("o_custkey").alias("label")).agg(
        F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col(code))).alias("a"),
        F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col(code))).alias("b"),
    )
    return sides.where((F.size("a") > 0) & (F.size("b") > 0))


@query(
    "f1_union_all",
    """SELECT c_nationkey AS place, c_acctbal AS amount FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""",
)
def f1(t: Tables) -> DataFrame:
    one = t.customer.select(F.col("c_nationkey").alias("place"), F.col("c_acctbal").alias("amount"))
    two = t.supplier.select(F.col("s_acctbal").alias("amount"), F.col("s_nationkey").alias("place"))
    return one.unionByName(two)


@query("f2_union", "SELECT l_partkey AS item FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size > 40")
def f2(t: Tables) -> DataFrame:
    one = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("item"))
    return one.union(t.part.where("p_size > 40").select("p_partkey")).distinct()


@query("f2_array_union", f"{TWO} SELECT label, array_to_string(list_sort(list_distinct(a || b)), ';') AS codes FROM f JOIN o USING (label)")
def f2_array(t: Tables) -> DataFrame:
    return two_sets(t).select("label", F.array_join(F.array_sort(F.array_union("a", "b")), ";").alias("codes"))


@query("f3_except", "SELECT p_partkey AS item FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def f3(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("item")).subtract(t.lineitem.where("l_quantity > 45").select("l_partkey").distinct())


@query(
    "f3_array_except",
    f"{TWO} SELECT label, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ';') AS codes FROM f JOIN o USING (label)",
)
def f3_array(t: Tables) -> DataFrame:
    return two_sets(t).select("label", F.array_join(F.array_sort(F.array_except("a", "b")), ";").alias("codes"))


@query("f4_intersect", "SELECT c_nationkey AS place FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def f4(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("place")).intersect(t.supplier.select("s_nationkey"))


@query("f4_array_intersect", f"{TWO} SELECT label, array_to_string(list_sort(list_intersect(a, b)), ';') AS codes FROM f JOIN o USING (label)")
def f4_array(t: Tables) -> DataFrame:
    return two_sets(t).select("label", F.array_join(F.array_sort(F.array_intersect("a", "b")), ";").alias("codes"))


@query("f5_subset", f"{FEW} SELECT label, CAST(list_has_all(b, a) AS BIGINT) AS subset FROM f JOIN o USING (label)")
def f5(t: Tables) -> DataFrame:
    return two_sets(t, "p_type").select("label", n64((F.size(F.array_except("a", "b")) == 0).cast("int")).alias("subset"))


@query("f6_set_equality", f"{FEW} SELECT label, CAST(list_sort(a) = list_sort(b) AS BIGINT) AS same FROM f JOIN o USING (label)")
def f6(t: Tables) -> DataFrame:
    return two_sets(t, "p_type").select("label", n64((F.array_sort("a") == F.array_sort("b")).cast("int")).alias("same"))


MERGED = """WITH one AS (SELECT p_name || '-' || p_type AS key, p_brand AS value, p_partkey AS place FROM part WHERE p_size < 30),
two AS (SELECT p_name || '-' || p_type AS key, 'size ' || p_size AS value, p_partkey AS place FROM part WHERE p_size > 20),
a AS (SELECT key, arg_max(value, place) AS value FROM one GROUP BY 1), b AS (SELECT key, arg_max(value, place) AS value FROM two GROUP BY 1)"""


def keyed_inputs(t: Tables) -> list[DataFrame]:
    """Two keyed tables that overlap in part, rows in the order of ``place``."""
    key = F.concat_ws("-", "p_name", "p_type")
    one = t.part.where("p_size < 30").select(key.alias("key"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("place"))
    two = t.part.where("p_size > 20").select(key.alias("key"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("value"), F.col("p_partkey").alias("place"))
    return [one, two]


@query(
    "f7_merge_later_wins",
    f"""{MERGED} SELECT coalesce(a.key, b.key) AS key, coalesce(b.value, a.value) AS value, CASE WHEN b.key IS NULL THEN 0 ELSE 1 END::BIGINT AS input,
  CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS replaced FROM a FULL JOIN b ON a.key = b.key""",
)
def f7(t: Tables) -> DataFrame:
    """Keys of either input; where both have one, the later input's value stands."""
    merged = R.merge_keyed(keyed_inputs(t), ["key"], "place")
    return merged.select("key", "value", n64("input").alias("input"), n64((F.col("inputs") > 1).cast("int")).alias("replaced"))


@query(
    "f7_keyed_update",
    f"""{MERGED} SELECT a.key, coalesce(b.value, a.value) AS value FROM a LEFT JOIN b ON a.key = b.key""",
)
def f7_update(t: Tables) -> DataFrame:
    """Only keys that the first input has are brought up to date."""
    one, two = keyed_inputs(t)
    known = one.select("key").distinct()
    return R.merge_keyed([one, two.join(known, "key", "left_semi")], ["key"], "place").select("key", "value")
