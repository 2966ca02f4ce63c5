"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import quality as Q
from ..operators import records as R
from . import roles as S
from .registry import Tables, query
from .roles import n64


@query(
    "p1_dictionary_sizes",
    """SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS "left", (SELECT count(*) FROM nation) AS "right", CAST((SELECT count(DISTINCT c_nationkey) FROM customer) = (SELECT count(*) FROM nation) AS INTEGER) AS same""",
)
def p1(t: Tables) -> DataFrame:
    return Q.count_difference(t.customer.select("c_nationkey").distinct(), t.nation)


@query(
    "p2_orphans",
    """SELECT 'symptom without condition' AS "check", count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'condition without symptom', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def p2(t: Tables) -> DataFrame:
    one = Q.orphans(t.lineitem, t.orders, "l_orderkey", "o_orderkey").agg(S.count_rows().alias("n"))
    two = Q.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey").agg(S.count_rows().alias("n"))
    return one.select(F.lit("symptom without condition").alias("check"), "n").unionByName(
        two.select(F.lit("condition without symptom").alias("check"), "n")
    )


ALLOWED = """own AS (SELECT DISTINCT s_nationkey AS condition, l_partkey AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def allowed_pairs(t: Tables) -> DataFrame:
    """The rule table: the parts that suppliers of a nation delivered; what its customers ordered is held against it."""
    joined = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("s_nationkey").cast("int").alias("condition"), F.col("l_partkey").alias("code")).distinct()


@query(
    "p3_symptoms_not_allowed",
    f"""WITH {ALLOWED} SELECT CAST(c_nationkey AS BIGINT) AS condition, l_partkey AS code, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE (c_nationkey, l_partkey) NOT IN (SELECT (condition, code) FROM own) GROUP BY ALL""",
)
def p3(t: Tables) -> DataFrame:
    owners = R.join_patients(S.conditions(t), S.patients(t)).select("row_id", F.col("nation").alias("condition"))
    seen = t.lineitem.select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("code")).join(owners, "row_id")
    return Q.not_allowed(seen, allowed_pairs(t), ["condition", "code"]).withColumn("condition", n64("condition"))


@query(
    "p4_onset_before_birth",
    """SELECT o_orderpriority AS label, count(*) AS rows, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def p4(t: Tables) -> DataFrame:
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("o_orderpriority", "label")
    return Q.order_violations(both, "o_orderdate", "l_shipdate", ["label"])


@query("p5_parsed_against_raw", "SELECT 0::BIGINT AS differing")
def p5(t: Tables) -> DataFrame:
    raw = R.symptom_sets(S.symptom_rows(t), "row_id", "code", "raw")
    text = R.compact_rows(S.reported(t)).select("row_id", F.split("SYMPTOMS", ";").alias("parsed"))
    return Q.set_differences(raw, text, "row_id", "raw", "parsed").agg(S.count_rows().alias("differing"))


@query("p5_planted_differences", f"{S.BASE} SELECT row_id FROM rec WHERE len(codes) > 0 AND (row_id % 7 = 0 OR row_id % 11 = 0)")
def p5_planted(t: Tables) -> DataFrame:
    """In some texts the first code is missing, in others one is spelled otherwise; just these are found."""
    raw = R.symptom_sets(S.symptom_rows(t), "row_id", "code", "raw")
    parsed = F.split("SYMPTOMS", ";")
    less = F.slice(parsed, 2, 1000)
    other = F.transform(parsed, lambda c: F.when(c == F.get(parsed, 0), F.lower(c)).otherwise(c))
    planted = F.when(F.col("row_id") % 7 == 0, less).when(F.col("row_id") % 11 == 0, other).otherwise(parsed)
    text = R.compact_rows(S.reported(t)).select("row_id", planted.alias("parsed"))
    return Q.set_differences(raw, text, "row_id", "raw", "parsed")


@query(
    "p6_symptom_counts_before_after",
    f"""{S.BASE}, a AS (SELECT label, len(codes) AS n FROM rec), b AS (SELECT label, count(l_orderkey) AS n FROM rec LEFT JOIN lineitem ON row_id = l_orderkey GROUP BY row_id, label),
u AS (SELECT label, n, 1 AS a, 0 AS b FROM a UNION ALL SELECT label, n, 0, 1 FROM b)
SELECT label, CAST(n AS BIGINT) AS n, CAST(sum(a) AS BIGINT) AS "left", CAST(sum(b) AS BIGINT) AS "right" FROM u GROUP BY label, n HAVING sum(a) <> sum(b)""",
)
def p6(t: Tables) -> DataFrame:
    """Counts with repeats against counts of distinct codes: the rows tell where they differ."""
    after = S.coded(t).select("label", n64(F.size("codes")).alias("n"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(S.count_rows().alias("k"))
    before = S.conditions(t).join(lines, F.col("row_id") == F.col("id"), "left").select("label", F.coalesce("k", F.lit(0)).alias("n"))
    return Q.multiset_difference(after, before, ["label", "n"])


@query("p7_vector_width", "SELECT count(*) FILTER (WHERE len(embedding) <> 64 OR embedding IS NULL) AS wrong FROM embeddings")
def p7(t: Tables) -> DataFrame:
    return Q.wrong_width(t.embeddings, F.size("embedding"), 64).agg(S.count_rows().alias("wrong"))
