"""How the given star-schema tables play the roles of the clinical record files.

patients    customer: id, market segment as race
conditions  orders: id, patient, priority as condition, status as gender, price as age
symptoms    lineitem with part: order, brand as symptom code
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes as C
from ..operators import records as R
from .registry import Tables

# The five market segments in sorted order stand for the five race codes.
SEGMENTS = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}


def patients(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("Id"), F.col("c_mktsegment").alias("RACE"), F.col("c_nationkey").alias("nation")
    )


def conditions(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("PATIENT"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_orderstatus").alias("GENDER"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("age"),
        F.col("o_orderdate").alias("ONSET"),
    )


def symptom_rows(t: Tables) -> DataFrame:
    """The raw fact: one row per reported symptom, repeats included."""
    return (
        t.lineitem.select(F.col("l_orderkey").alias("row_id"), "l_partkey")
        .join(t.part.select("p_partkey", F.col("p_brand").alias("code")), F.col("l_partkey") == F.col("p_partkey"))
        .select("row_id", "code")
    )


def dictionary(t: Tables) -> DataFrame:
    """Symptom codes numbered in sorted order: (code, idx)."""
    return R.number_codes(t.part, "p_brand")


def records(t: Tables) -> DataFrame:
    """Design rows: row_id, PATIENT, label, source, gender, race, age, nation, codes."""
    rows = R.design_rows(conditions(t), patients(t), symptom_rows(t), "row_id", "code", "PATIENT", "Id")
    return rows.select(
        "row_id",
        "PATIENT",
        "label",
        F.col("GENDER").alias("source"),
        C.gender_code(F.col("GENDER")).alias("gender"),
        C.race_code(F.col("RACE"), SEGMENTS).alias("race"),
        "age",
        "nation",
        "codes",
    )


def coded(t: Tables) -> DataFrame:
    """Design rows without the patient: row_id, label, source, gender, age, codes; one shuffle less."""
    rows = conditions(t)
    sets = R.symptom_sets(symptom_rows(t), "row_id", "code").withColumnRenamed("row_id", "_sk")
    joined = rows.join(sets, F.col("row_id") == F.col("_sk"), "left")
    return joined.select(
        "row_id",
        "label",
        F.col("GENDER").alias("source"),
        C.gender_code(F.col("GENDER")).alias("gender"),
        "age",
        F.coalesce("codes", F.array().cast("array<string>")).alias("codes"),
    )


def reported(t: Tables) -> DataFrame:
    """Coded rows with at least one symptom."""
    return coded(t).where(F.size("codes") > 0)


def count_rows() -> Column:
    return F.count(F.lit(1))


def r6(column: Column) -> Column:
    return F.round(column.cast("double"), 6)


def n64(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# The same roles in SQL, as common table expressions.
SYM = """sym AS (SELECT DISTINCT l_orderkey AS row_id, p_brand AS code FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SETS = """sets AS (SELECT row_id, list_sort(list(code)) AS codes FROM sym GROUP BY row_id)"""
REC = """rec AS (SELECT o_orderkey AS row_id, o_custkey AS patient, o_orderpriority AS label, o_orderstatus AS source,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS gender,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS race,
  CAST(floor(o_totalprice / 5000) AS INTEGER) AS age, c_nationkey AS nation,
  coalesce(codes, []) AS codes
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN sets ON row_id = o_orderkey)"""
DIC = """dic AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS idx FROM (SELECT DISTINCT p_brand AS code FROM part))"""
BASE = f"WITH {SYM}, {SETS}, {REC}, {DIC}"
