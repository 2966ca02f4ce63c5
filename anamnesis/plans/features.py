"""Feature vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions import codes as C
from ..operators import ensembles as E
from ..operators import features as L
from ..operators import records as R
from ..operators.sizes import store
from . import roles as S
from .registry import Tables, query
from .roles import n64, r6

CODES = "sym JOIN dic USING (code)"


def base_rows(t: Tables) -> DataFrame:
    return S.records(t)


def words(t: Tables) -> list[str]:
    return L.code_list(S.dictionary(t))


def flat(rows: DataFrame) -> DataFrame:
    return L.nonzero(rows, ["row_id"]).select("row_id", n64("idx").alias("idx"), r6(F.col("value")).alias("value"))


@query(
    "l1_sparse_rows",
    f"""{S.BASE} SELECT row_id, 0::BIGINT AS idx, 1.0::DOUBLE AS value FROM rec WHERE gender = 1 UNION ALL SELECT row_id, 1, race FROM rec WHERE race > 0
UNION ALL SELECT row_id, 2, age FROM rec WHERE age <> 0 UNION ALL SELECT row_id, idx + 3, 1.0 FROM {CODES}""",
)
def l1(t: Tables) -> DataFrame:
    return flat(L.sparse_rows(base_rows(t), words(t)))


HOT = f"""UNION ALL SELECT row_id, 1, 1.0 FROM rec WHERE gender = 1 UNION ALL SELECT row_id, 2 + race, 1.0 FROM rec UNION ALL SELECT row_id, idx + 7, 1.0 FROM {CODES}"""


@query(
    "l2_one_hot_scaled_age",
    f"""{S.BASE}, a AS (SELECT row_id, (age - avg(age) OVER ()) / stddev_samp(age) OVER () AS z FROM rec)
SELECT row_id, 0::BIGINT AS idx, round(z, 6) AS value FROM a WHERE z <> 0 {HOT}""",
)
def l2(t: Tables) -> DataFrame:
    # Read twice: for mean and deviation of the age, and for the vectors.
    rows = store(base_rows(t), "records")
    return flat(L.one_hot_rows(rows, words(t), True))


@query("l3_one_hot_raw_age", f"{S.BASE} SELECT row_id, 0::BIGINT AS idx, age::DOUBLE AS value FROM rec WHERE age <> 0 {HOT}")
def l3(t: Tables) -> DataFrame:
    return flat(L.one_hot_rows(base_rows(t), words(t), False))


@query(
    "l4_race_one_hot",
    f"""{S.BASE} SELECT row_id, repeat('0', 4 - race) || '1' || repeat('0', race) AS bits FROM rec""",
)
def l4(t: Tables) -> DataFrame:
    bits = F.transform(C.one_hot_race(F.col("race")), lambda b: b.cast("string"))
    return base_rows(t).select("row_id", F.array_join(bits, "").alias("bits"))


@query(
    "l5_coded_values",
    f"""{S.BASE}, v AS (SELECT l_orderkey AS row_id, p_brand AS code, max(l_linenumber) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT row_id, 0::BIGINT AS idx, 1.0::DOUBLE AS value FROM rec WHERE gender = 1 AND len(codes) > 0 UNION ALL SELECT row_id, 1, race FROM rec WHERE race > 0 AND len(codes) > 0
UNION ALL SELECT row_id, 2, age FROM rec WHERE age <> 0 AND len(codes) > 0 UNION ALL SELECT row_id, idx + 3, v FROM v JOIN dic USING (code)""",
)
def l5(t: Tables) -> DataFrame:
    facts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    values = facts.groupBy(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("code")).agg(F.max("l_linenumber").alias("v"))
    numbered = values.join(S.dictionary(t), "code")
    maps = numbered.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), "v"))).alias("m"))
    rows = base_rows(t).join(maps, F.col("row_id") == F.col("id"))
    return flat(L.valued_rows(rows, "m", len(words(t))))


@query("l6_ordinal", "SELECT p_partkey AS item, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code FROM part")
def l6(t: Tables) -> DataFrame:
    return L.ordinal(t.part, "p_type", "code").select(F.col("p_partkey").alias("item"), "code")


@query(
    "l7_permuted_columns",
    """SELECT vec_id, round((embedding[11] - embedding[21])::DOUBLE, 6) AS front, round(embedding[1]::DOUBLE, 6) AS next, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings""",
)
def l7(t: Tables) -> DataFrame:
    rows = L.permuted(E.dense_features(t.embeddings, "embedding"), "features", [10, 20], 64)
    v = vector_to_array("permuted")
    # Single-precision difference, as in the stored vectors.
    front = (F.get(v, 0).cast("float") - F.get(v, 1).cast("float")).cast("double")
    return rows.select("vec_id", r6(front).alias("front"), r6(F.get(v, 2)).alias("next"), r6(F.get(v, 63)).alias("last"))


@query("l8_label_encode", "SELECT o_orderkey AS row_id, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS label FROM orders")
def l8(t: Tables) -> DataFrame:
    return L.ordinal(t.orders, "o_orderpriority", "label").select(F.col("o_orderkey").alias("row_id"), "label")


@query(
    "l9_nominal_default",
    """SELECT o_orderkey AS row_id, CAST(l_linenumber AS BIGINT) AS line, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 9 END AS code FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""",
)
def l9(t: Tables) -> DataFrame:
    encoding = t.lineitem.select(F.col("l_returnflag").alias("value")).where(F.col("value") != "N").distinct()
    encoding = encoding.withColumn("code", F.when(F.col("value") == "A", 1).otherwise(2))
    rows = R.fan_out(t.orders, t.lineitem, "o_orderkey", "l_orderkey")
    coded = L.nominal(rows, "l_returnflag", encoding, 9, "code")
    return coded.select(F.col("o_orderkey").alias("row_id"), n64("l_linenumber").alias("line"), "code")


@query("l10_latent_components")
def l10(t: Tables) -> DataFrame:
    latent = E.compress(E.dense_features(t.embeddings, "embedding"), "features", 3)
    return latent.select("vec_id", *[r6(F.get("latent", i)).alias(f"z{i}") for i in range(3)])


@query("l11_layout_check", f"{S.BASE} SELECT 0::BIGINT AS gender, 0::BIGINT AS age, 0::BIGINT AS race, 0::BIGINT AS codes, count(*) AS rows FROM rec")
def l11(t: Tables) -> DataFrame:
    rows, names = store(base_rows(t), "records"), words(t)
    return L.layout_differences(L.sparse_rows(rows, names), L.one_hot_rows(rows, names, False), "row_id", len(names))


@query(
    "l11_planted_differences",
    f"""{S.BASE} SELECT count(*) FILTER (WHERE row_id % 5 = 0) AS gender, count(*) FILTER (WHERE row_id % 7 = 0) AS age, count(*) FILTER (WHERE row_id % 3 = 0) AS race,
  count(*) FILTER (WHERE row_id % 2 = 0 AND len(codes) > 0) AS codes, count(*) AS rows FROM rec""",
)
def l11_planted(t: Tables) -> DataFrame:
    """The second layout is made of rows with another gender, age, race or code; the check counts each."""
    rows, names = store(base_rows(t), "records"), words(t)

    def where(n: int, value, column: str):
        return F.when(F.col("row_id") % n == 0, value).otherwise(F.col(column))

    other = rows.withColumns(
        {
            "gender": where(5, 1 - F.col("gender"), "gender"),
            "age": where(7, F.col("age") + 1, "age"),
            "race": where(3, (F.col("race") + 1) % 5, "race"),
            "codes": where(2, F.slice("codes", 2, 1000), "codes"),
        }
    )
    return L.layout_differences(L.sparse_rows(rows, names), L.one_hot_rows(other, names, False), "row_id", len(names))
