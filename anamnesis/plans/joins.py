"""Joins: records from the three exports, dictionary lookups, semi and anti joins, class pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import codes as C
from ..operators import pairwise as P
from ..operators import rates as B
from ..operators import records as R
from ..operators.sizes import settle
from . import roles as S
from .registry import Tables, query
from .roles import n64, r6

DESIGN_SQL = f"""{S.BASE}
SELECT row_id, label, CAST(gender AS BIGINT) AS gender, CAST(race AS BIGINT) AS race, CAST(age AS BIGINT) AS age,
  CAST(len(codes) AS BIGINT) AS n_codes, array_to_string(codes, ';') AS codes FROM rec"""


@query("design_matrix", DESIGN_SQL)
def design_matrix(t: Tables) -> DataFrame:
    return S.records(t).select(
        "row_id",
        "label",
        n64("gender").alias("gender"),
        n64("race").alias("race"),
        n64("age").alias("age"),
        n64(F.size("codes")).alias("n_codes"),
        F.array_join("codes", ";").alias("codes"),
    )


RATE_SQL = f"""{S.BASE},
cls AS (SELECT label, count(*) AS n FROM rec GROUP BY label)
SELECT label, code, count(*) AS hits, any_value(n) AS n, round(count(*) / any_value(n), 6) AS rate
FROM rec JOIN sym USING (row_id) JOIN cls USING (label) GROUP BY label, code"""


@query("class_symptom_rate", RATE_SQL)
def class_symptom_rate(t: Tables) -> DataFrame:
    return B.class_rates(S.coded(t), "label", "codes").select("label", "code", "hits", "n", r6(F.col("rate")).alias("rate"))


@query(
    "c1_conditions_patients",
    """SELECT o_orderkey AS row_id, o_orderpriority AS label, c_mktsegment AS race
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def c1(t: Tables) -> DataFrame:
    return R.join_patients(S.conditions(t), S.patients(t)).select("row_id", "label", F.col("RACE").alias("race"))


@query(
    "c2_symptoms_conditions",
    """SELECT l_orderkey AS row_id, CAST(l_linenumber AS BIGINT) AS line, o_orderpriority AS label, c_mktsegment AS race
FROM lineitem LEFT JOIN (SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey) ON l_orderkey = o_orderkey""",
)
def c2(t: Tables) -> DataFrame:
    known = R.join_patients(S.conditions(t), S.patients(t)).select(F.col("row_id").alias("Id"), "label", "RACE")
    facts = t.lineitem.select(F.col("l_orderkey").alias("CONDITION_ID"), F.col("l_linenumber").alias("line"))
    out = R.join_conditions(facts, known)
    return out.select(F.col("CONDITION_ID").alias("row_id"), n64("line").alias("line"), "label", F.col("RACE").alias("race"))


@query(
    "c3_encounter_symptoms",
    """SELECT o_orderkey AS encounter, p_brand AS code, count(*) AS n
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def c3(t: Tables) -> DataFrame:
    counted = S.symptom_rows(t).groupBy("row_id", "code").agg(F.count(F.lit(1)).alias("n"))
    found = t.orders.select(F.col("o_orderkey").alias("encounter")).join(
        counted, F.col("encounter") == F.col("row_id"), "left"
    )
    return found.select("encounter", "code", F.coalesce("n", F.lit(1)).alias("n"))


@query(
    "c4_four_way",
    """SELECT o_orderkey AS encounter, CAST(l_linenumber AS BIGINT) AS obs, l_quantity AS value, o_orderpriority AS label,
  c_mktsegment AS race, n_name AS place
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def c4(t: Tables) -> DataFrame:
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return (
        R.fan_out(t.orders, t.lineitem, "o_orderkey", "l_orderkey")
        .join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_orderkey").alias("encounter"),
            n64("l_linenumber").alias("obs"),
            F.col("l_quantity").alias("value"),
            F.col("o_orderpriority").alias("label"),
            F.col("c_mktsegment").alias("race"),
            F.col("n_name").alias("place"),
        )
    )


@query(
    "c5_inner",
    """SELECT o_orderkey AS row_id, c_name AS patient FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def c5(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"), F.col("c_name").alias("patient")
    )


@query(
    "c7_suffixes",
    """SELECT l.l_orderkey AS row_id, CAST(l.l_linenumber AS BIGINT) AS line, CAST(l.l_shipdate AS DATE) AS day_symp,
  CAST(o.o_orderdate AS DATE) AS day FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey""",
)
def c7(t: Tables) -> DataFrame:
    left = t.lineitem.select(
        F.col("l_orderkey").alias("CONDITION_ID"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("date").alias("day")
    )
    right = t.orders.select(F.col("o_orderkey").alias("Id"), F.col("o_orderdate").cast("date").alias("day"))
    return R.join_conditions(left, right).select(
        F.col("CONDITION_ID").alias("row_id"), n64("line").alias("line"), "day_symp", "day"
    )


@query(
    "c8_dictionary_lookup",
    f"""WITH {S.DIC} SELECT p_partkey AS item, CAST(idx AS BIGINT) AS idx,
  CAST(CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'PROMO' THEN 1 END AS BIGINT) AS kind FROM part LEFT JOIN dic ON p_brand = code""",
)
def c8(t: Tables) -> DataFrame:
    return (
        t.part.join(S.dictionary(t), F.col("p_brand") == F.col("code"), "left")
        .select(
            F.col("p_partkey").alias("item"),
            n64("idx").alias("idx"),
            n64(C.lookup(F.col("p_type"), {"ECONOMY": 0, "PROMO": 1})).alias("kind"),
        )
    )


@query(
    "c9_semi_encounters",
    """SELECT o_orderkey AS row_id, o_orderpriority AS label FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def c9(t: Tables) -> DataFrame:
    # The distinct keys: a key repeated in many rows must not meet in one task.
    returned = t.lineitem.where(F.col("l_returnflag") == "R").select("l_orderkey").distinct()
    return t.orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label")
    )


CLASS_SETS = """own AS (SELECT DISTINCT o_custkey AS condition, p_name AS code FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def class_sets(t: Tables) -> DataFrame:
    """A sparse definition table: (condition, code), customers and the names of what they ordered."""
    return (
        t.lineitem.select("l_orderkey", "l_partkey")
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("condition"), F.col("p_name").alias("code"))
        .distinct()
    )


@query(
    "c10_missing_symptoms",
    f"""WITH {CLASS_SETS}, vocab AS (SELECT DISTINCT p_name AS code FROM part)
SELECT condition, code FROM (SELECT DISTINCT condition FROM own) CROSS JOIN vocab WHERE (condition, code) NOT IN (SELECT (condition, code) FROM own)""",
)
def c10(t: Tables) -> DataFrame:
    vocabulary = t.part.select(F.col("p_name").alias("code"))
    return B.absent_codes(class_sets(t), "condition", "code", vocabulary).select("condition", "code")


PLACE_SETS = """own AS (SELECT DISTINCT c_nationkey AS condition, l_partkey::VARCHAR AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def place_sets(t: Tables) -> DataFrame:
    """(condition, code): nations and the parts that they ordered; no nation has all."""
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    placed = lines.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return placed.select(F.col("c_nationkey").cast("int").alias("condition"), F.col("l_partkey").cast("string").alias("code")).distinct()


@query(
    "c11_class_pairs",
    f"""WITH {PLACE_SETS} SELECT CAST(a.condition AS BIGINT) AS a, CAST(b.condition AS BIGINT) AS b, count(*) AS shared
FROM own a JOIN own b ON a.code = b.code AND a.condition < b.condition GROUP BY ALL""",
)
def c11(t: Tables) -> DataFrame:
    ones = place_sets(t).withColumn("w", F.lit(1.0))
    return P.dot_products(ones, "condition", "code", "w").select(
        n64("a").alias("a"), n64("b").alias("b"), n64(F.round("dot")).alias("shared")
    )


@query(
    "c12_cooccurrence_graph",
    f"""WITH {CLASS_SETS} SELECT a.code AS a, b.code AS b, count(*) AS edges
FROM own a JOIN own b ON a.condition = b.condition AND a.code < b.code GROUP BY ALL""",
)
def c12(t: Tables) -> DataFrame:
    ones = class_sets(t).withColumn("w", F.lit(1.0))
    return P.dot_products(ones, "code", "condition", "w").select("a", "b", n64(F.round("dot")).alias("edges"))


@query(
    "c13_round_trip",
    f"""{S.BASE}, parsed AS (SELECT row_id, list_sort(list_distinct(string_split(array_to_string(codes, ';'), ';'))) AS c FROM sets)
SELECT coalesce(s.row_id, p.row_id) AS row_id, CAST(coalesce(s.codes = p.c, false) AS BIGINT) AS same
FROM sets s FULL OUTER JOIN parsed p ON s.row_id = p.row_id""",
)
def c13(t: Tables) -> DataFrame:
    raw = R.symptom_sets(S.symptom_rows(t), "row_id", "code")
    text = R.compact_rows(S.reported(t)).select(F.col("row_id").alias("pid"), "SYMPTOMS")
    parsed = text.select("pid", F.array_sort(F.array_distinct(F.split("SYMPTOMS", ";"))).alias("back"))
    both = raw.join(parsed, F.col("row_id") == F.col("pid"), "full")
    return both.select(
        F.coalesce("row_id", "pid").alias("row_id"),
        n64(F.coalesce(F.col("codes") == F.col("back"), F.lit(False)).cast("int")).alias("same"),
    )


@query(
    "c14_model_columns",
    """WITH m AS (SELECT year(o_orderdate) AS dataset, o_orderstatus AS model, avg(o_totalprice) AS score FROM orders GROUP BY ALL)
SELECT CAST(a.dataset AS BIGINT) AS dataset, round(a.score, 6) AS nb, round(b.score, 6) AS rf, round(c.score, 6) AS mlp
FROM m a JOIN m b ON a.dataset = b.dataset AND a.model = 'F' AND b.model = 'O' JOIN m c ON c.dataset = a.dataset AND c.model = 'P'""",
)
def c14(t: Tables) -> DataFrame:
    runs = settle(
        t.orders.groupBy(F.year("o_orderdate").alias("dataset"), F.col("o_orderstatus").alias("model")).agg(F.avg("o_totalprice").alias("score"))
    )
    nb = runs.where("model = 'F'").select("dataset", F.round("score", 6).alias("nb"))
    rf = runs.where("model = 'O'").select("dataset", F.round("score", 6).alias("rf"))
    mlp = runs.where("model = 'P'").select("dataset", F.round("score", 6).alias("mlp"))
    return nb.join(rf, "dataset").join(mlp, "dataset").withColumn("dataset", n64("dataset"))


@query(
    "c15_baseline_join",
    f"""{S.BASE}, p AS (SELECT source, label, code, count(*) AS n FROM rec JOIN sym USING (row_id) GROUP BY ALL)
SELECT v.source, v.label, v.code, CAST(v.n - coalesce(b.n, 0) AS BIGINT) AS diff
FROM p v LEFT JOIN p b ON b.source = 'F' AND b.label = v.label AND b.code = v.code WHERE v.source <> 'F'""",
)
def c15(t: Tables) -> DataFrame:
    flat = S.coded(t).select("source", "label", F.explode("codes").alias("code"))
    counts = settle(flat.groupBy("source", "label", "code").agg(F.count(F.lit(1)).alias("n")))
    base = counts.where("source = 'F'").select("label", "code", F.col("n").alias("base_n"))
    return (
        counts.where("source <> 'F'")
        .join(base, ["label", "code"], "left")
        .select("source", "label", "code", (F.col("n") - F.coalesce("base_n", F.lit(0))).alias("diff"))
    )


@query(
    "c16_one_group",
    """SELECT l_orderkey AS row_id, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS quantity FROM lineitem WHERE l_orderkey = 42""",
)
def c16(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_orderkey") == 42).select(
        F.col("l_orderkey").alias("row_id"), n64("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity")
    )
