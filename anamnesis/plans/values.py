"""Dates, ages, codes, bit sets, probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import codes as C
from ..functions import maths as M
from ..operators import records as R
from ..operators import scores as K
from ..operators.sizes import settle
from . import roles as S
from .registry import Tables, query
from .roles import n64, r6

DATES = "SELECT l_orderkey AS row_id, CAST(l_linenumber AS BIGINT) AS line, {} AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
DAYS = "datediff('day', o_orderdate, l_shipdate)"


def dated(t: Tables, mode: str) -> DataFrame:
    """Order date as birth, ship date as onset."""
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    years = C.age(F.col("o_orderdate"), F.col("l_shipdate"), mode)
    return both.select(F.col("l_orderkey").alias("row_id"), n64("l_linenumber").alias("line"), years.alias("age"))


@query("i1_age_calendar", DATES.format("CAST(abs(year(o_orderdate) - year(l_shipdate)) AS INTEGER)"))
def i1(t: Tables) -> DataFrame:
    return dated(t, "calendar")


@query("i2_age_mean_years", DATES.format(f"CAST(abs(CAST(trunc({DAYS} / 365.2425::DOUBLE) AS INTEGER)) AS INTEGER)"))
def i2(t: Tables) -> DataFrame:
    return dated(t, "years")


@query("i3_age_months", DATES.format(f"round(trunc({DAYS} / (365.2425::DOUBLE / 12)) / 12.0::DOUBLE, 6)"))
def i3(t: Tables) -> DataFrame:
    return dated(t, "months").withColumn("age", r6(F.col("age")))


@query("i3_age_months_cut", DATES.format(f"CAST(trunc(trunc({DAYS} / (365.2425::DOUBLE / 12)) / 12.0::DOUBLE) AS INTEGER)"))
def i3_cut(t: Tables) -> DataFrame:
    return dated(t, "months_int")


@query(
    "i4_age_on_day",
    """SELECT CAST(trunc(datediff('day', o_orderdate, DATE '2020-04-01') / 365.2425::DOUBLE) AS INTEGER) AS age, count(*) AS n FROM orders GROUP BY 1""",
)
def i4(t: Tables) -> DataFrame:
    return t.orders.groupBy(C.age_on(F.col("o_orderdate"), "2020-04-01").alias("age")).agg(S.count_rows().alias("n"))


@query("i5_gender_code", "SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS gender FROM orders")
def i5(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("row_id"), C.gender_code(F.col("o_orderstatus")).alias("gender"))


@query(
    "i6_gender_marital_missing",
    """SELECT o_orderkey AS row_id, CASE WHEN l_returnflag IS NULL THEN 2 WHEN l_returnflag = 'F' THEN 0 ELSE 1 END AS gender,
  CASE WHEN l_returnflag = 'M' THEN 1 WHEN l_returnflag = 'S' THEN 0 ELSE 2 END AS marital FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""",
)
def i6(t: Tables) -> DataFrame:
    both = R.fan_out(t.orders, t.lineitem, "o_orderkey", "l_orderkey")
    flag = F.col("l_returnflag")
    return both.select(F.col("o_orderkey").alias("row_id"), C.gender_code(flag, 2).alias("gender"), C.marital_code(flag).alias("marital"))


@query(
    "i7_race_code",
    """SELECT c_custkey AS patient, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS race,
  CAST(NULL AS INTEGER) AS other FROM customer""",
)
def i7(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    return t.customer.select(
        F.col("c_custkey").alias("patient"), C.race_code(segment, S.SEGMENTS).alias("race"), C.race_code(segment).alias("other")
    )


MASKS = f"{S.BASE}, m AS (SELECT row_id, bit_or(CAST(1 AS BIGINT) << CAST(idx AS INTEGER)) AS mask FROM sym JOIN dic USING (code) GROUP BY 1)"


def masks(t: Tables) -> DataFrame:
    sets = R.with_indices(S.reported(t), "codes", S.dictionary(t))
    return sets.select("row_id", "idx", C.bit_mask(F.col("idx")).alias("mask"))


@query("i8_bit_test", f"{MASKS} SELECT row_id, CAST((mask >> 3) & 1 AS INTEGER) AS b3, CAST((mask >> 24) & 1 AS INTEGER) AS b24 FROM m")
def i8(t: Tables) -> DataFrame:
    return masks(t).select("row_id", C.has_bit(F.col("mask"), 3).alias("b3"), C.has_bit(F.col("mask"), 24).alias("b24"))


@query(
    "i9_mask_of_list",
    f"""WITH {S.DIC} SELECT l_orderkey AS row_id, bit_or(CAST(1 AS BIGINT) << CAST(idx AS INTEGER)) AS mask
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN dic ON code = p_brand GROUP BY 1""",
)
def i9(t: Tables) -> DataFrame:
    """Repeats set their bit once: the or of single bits, folded before the shuffle."""
    coded = S.symptom_rows(t).join(S.dictionary(t), "code")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("idx").cast("int"))
    return coded.groupBy("row_id").agg(F.bit_or(bit).alias("mask"))


@query(
    "i10_bits_to_number",
    f"{S.BASE} SELECT row_id, CAST(sum(CAST(1 AS BIGINT) << CAST(24 - idx AS INTEGER)) AS BIGINT) AS number FROM sym JOIN dic USING (code) GROUP BY 1",
)
def i10(t: Tables) -> DataFrame:
    """As wide as the dictionary; one of more than 62 codes has no such number and is an error."""
    sets = R.with_indices(S.reported(t), "codes", S.dictionary(t)).withColumn("width", S.dictionary(t).agg(S.count_rows()).scalar())
    return sets.select("row_id", C.bits_to_number(C.multi_hot(F.col("idx"), F.col("width"))).alias("number"))


@query("i11_nonzero_names", f"{S.BASE} SELECT row_id, array_to_string(codes, ';') AS codes FROM sets")
def i11(t: Tables) -> DataFrame:
    names = S.dictionary(t).agg(F.array_sort(F.collect_list("code"))).scalar()
    bits = R.with_indices(S.reported(t), "codes", S.dictionary(t)).withColumn("names", names)
    named = F.transform(F.array_sort(F.array_distinct("idx")), lambda i: F.get("names", i.cast("int")))
    return bits.select("row_id", F.array_join(named, ";").alias("codes"))


@query("i12_value_at_label", "SELECT vec_id, round(embedding[label + 1]::DOUBLE, 6) AS p FROM embeddings")
def i12(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", r6(M.at_label(F.col("embedding"), F.col("label"))).alias("p"))


@query(
    "i13_label_in_top_n",
    """WITH f AS (SELECT vec_id, label AS own, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS label FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS rank FROM f)
SELECT vec_id, CAST(max(CASE WHEN own = label AND rank <= 3 THEN 1 ELSE 0 END) AS INTEGER) AS hit FROM r GROUP BY 1""",
)
def i13(t: Tables) -> DataFrame:
    scores = F.col("embedding").cast("array<double>")
    top = t.embeddings.select("vec_id", F.col("label").alias("own"), M.ranked(scores, 3).alias("top"))
    return top.select("vec_id", F.array_contains("top.label", F.col("own")).cast("int").alias("hit"))


@query("i14_clamp", "SELECT vec_id, round(greatest(0.001::DOUBLE, least(0.999::DOUBLE, embedding[1]::DOUBLE)), 6) AS p FROM embeddings")
def i14(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", r6(M.clamp(F.get("embedding", 0).cast("double"))).alias("p"))


SOFT = """WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS label FROM embeddings),
z AS (SELECT vec_id, max(x) AS m FROM f GROUP BY 1), l AS (SELECT vec_id, any_value(m) + ln(sum(exp(x - m))) AS lse FROM f JOIN z USING (vec_id) GROUP BY 1)"""


@query("i15_log_sum_exp", f"{SOFT} SELECT vec_id, round(lse, 6) AS lse FROM l")
def i15(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", r6(M.log_sum_exp(F.col("embedding").cast("array<double>"))).alias("lse"))


@query("i16_softmax", f"{SOFT} SELECT vec_id, CAST(label AS INTEGER) AS label, round(exp(x - lse), 6) AS p FROM f JOIN l USING (vec_id)")
def i16(t: Tables) -> DataFrame:
    soft = t.embeddings.select("vec_id", F.posexplode(M.softmax(F.col("embedding").cast("array<double>"))))
    return soft.select("vec_id", F.col("pos").alias("label"), r6(F.col("col")).alias("p"))


RUNS = """WITH m AS (SELECT l_suppkey AS run, avg(l_extendedprice) AS acc, sum(l_quantity) AS t, count(*)::DOUBLE AS s FROM lineitem GROUP BY 1),
e AS (SELECT min(acc) a0, max(acc) a1, min(t) t0, max(t) t1, min(s) s0, max(s) s1 FROM m),
n AS (SELECT run, acc, t, s, (acc - a0) / (a1 - a0) AS an, (t - t0) / (t1 - t0) AS tn, (s - s0) / (s1 - s0) AS sn FROM m, e)"""


def runs(t: Tables) -> DataFrame:
    """A run log: score, time and size per run."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("run")).agg(
        F.avg("l_extendedprice").alias("acc"), F.sum("l_quantity").alias("t"), S.count_rows().cast("double").alias("s")
    )


@query("i17_weighted_score", f"{RUNS} SELECT run, round(3 * an - 0.05 * tn - 0.05 * sn, 6) AS s3, round(-2 * an + 0.1 * tn + 0.1 * sn, 6) AS s4 FROM n")
def i17(t: Tables) -> DataFrame:
    n = K.normalised(runs(t), ["acc", "t", "s"])
    first, second = {"acc": 3, "t": -0.05, "s": -0.05}, {"acc": -2, "t": 0.1, "s": 0.1}
    return n.select("run", r6(K.weighted_score(first)).alias("s3"), r6(K.weighted_score(second)).alias("s4"))


@query(
    "i18_relative_change",
    f"{RUNS} SELECT run, round(((SELECT max(acc) FROM m) - acc) * 100 / (SELECT max(acc) FROM m), 6) AS loss FROM m",
)
def i18(t: Tables) -> DataFrame:
    log = settle(runs(t))
    best = log.agg(F.max("acc")).scalar()
    return log.withColumn("best", best).select("run", r6(M.relative_change(F.col("best"), F.col("acc"))).alias("loss"))


@query(
    "i19_odds",
    """WITH o AS (SELECT p_type AS condition, p_brand AS item, max(p_size)::DOUBLE AS odds FROM part GROUP BY ALL), p AS (SELECT *, odds / (odds + 1) AS p FROM o)
SELECT condition, item, round(p, 6) AS p, round(p / sum(p) OVER (PARTITION BY condition), 6) AS share FROM p""",
)
def i19(t: Tables) -> DataFrame:
    odds = t.part.groupBy(F.col("p_type").alias("condition"), F.col("p_brand").alias("item")).agg(F.max("p_size").cast("double").alias("odds"))
    p = odds.withColumn("p", M.odds_to_probability(F.col("odds")))
    return K.shares(p, ["condition"], "p").select("condition", "item", r6(F.col("p")).alias("p"), r6(F.col("share")).alias("share"))


@query(
    "i20_likelihood_share",
    """WITH g AS (SELECT c_nationkey AS condition, c_mktsegment AS grp, avg(c_acctbal) AS likelihood FROM customer GROUP BY ALL)
SELECT CAST(condition AS BIGINT) AS condition, grp, round(likelihood / (10 * sum(likelihood) OVER (PARTITION BY condition)), 6) AS share FROM g""",
)
def i20(t: Tables) -> DataFrame:
    groups = t.customer.groupBy(F.col("c_nationkey").cast("bigint").alias("condition"), F.col("c_mktsegment").alias("grp")).agg(
        F.avg("c_acctbal").alias("likelihood")
    )
    return K.shares(groups, ["condition"], "likelihood", 10.0).select("condition", "grp", r6(F.col("share")).alias("share"))


@query("i21_megabytes", "SELECT lang, round(sum(n_chars) / 1024 / 1024, 6) AS mb FROM documents GROUP BY 1")
def i21(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(r6(M.megabytes(F.sum("n_chars"))).alias("mb"))


@query(
    "i22_standardise",
    """SELECT o_orderkey AS row_id, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS z FROM orders""",
)
def i22(t: Tables) -> DataFrame:
    return K.standardised(t.orders, "o_totalprice", "z").select(F.col("o_orderkey").alias("row_id"), r6(F.col("z")).alias("z"))
