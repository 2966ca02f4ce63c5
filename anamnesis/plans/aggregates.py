"""Aggregations: class sizes, rates, folds, pivots, quantiles, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.codes import bit_mask
from ..operators import aggregates as A
from ..operators import ordering as O
from ..operators import rates as B
from ..operators import records as R
from ..operators.sizes import settle
from . import roles as S
from .joins import CLASS_SETS, class_sets
from .registry import Tables, query
from .roles import n64, r6

@query("d1_class_sizes", "SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def d1(t: Tables) -> DataFrame:
    return S.conditions(t).groupBy("label").agg(S.count_rows().alias("n"))


@query(
    "d2_mean_std",
    """SELECT year(o_orderdate) AS size, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std FROM orders GROUP BY 1""",
)
def d2(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("size")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 6).alias("std")
    )


@query(
    "d3_symptoms_of_condition",
    f"""WITH {CLASS_SETS} SELECT condition, array_to_string(list_sort(list(code)), ';') AS codes FROM own GROUP BY condition""",
)
def d3(t: Tables) -> DataFrame:
    """Customers as conditions: each has names that another lacks."""
    return R.symptom_sets(class_sets(t), "condition", "code").select("condition", F.array_join("codes", ";").alias("codes"))


@query(
    "d4_bernoulli_rates",
    f"""{S.BASE}, cls AS (SELECT nation, count(*) AS n FROM rec GROUP BY 1)
SELECT CAST(nation AS BIGINT) AS label, code, round(count(*) / any_value(n), 6) AS rate FROM rec JOIN sym USING (row_id) JOIN cls USING (nation) GROUP BY 1, 2""",
)
def d4(t: Tables) -> DataFrame:
    return B.class_rates(S.records(t), "nation", "codes").select(n64("nation").alias("label"), "code", r6(F.col("rate")).alias("rate"))


@query(
    "d5_rates_all_datasets",
    f"""{S.BASE}, cls AS (SELECT source, label, count(*) AS n FROM rec GROUP BY 1, 2)
SELECT source AS dataset, label, code, round(count(*) / any_value(n), 6) AS rate FROM rec JOIN sym USING (row_id) JOIN cls USING (source, label) GROUP BY ALL""",
)
def d5(t: Tables) -> DataFrame:
    rates = B.class_rates(S.coded(t), "label", "codes", ["source"])
    return rates.select(F.col("source").alias("dataset"), "label", "code", r6(F.col("rate")).alias("rate"))


@query(
    "d6_one_pass_stats",
    """SELECT round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders""",
)
def d6(t: Tables) -> DataFrame:
    p = "o_totalprice"
    return t.orders.agg(
        F.round(F.avg(p), 6).alias("mean"), F.round(F.stddev_samp(p), 6).alias("std"), F.min(p).alias("min"), F.max(p).alias("max")
    )


@query(
    "d7_counts_per_integer",
    """WITH a AS (SELECT CAST(floor(o_totalprice / 5000) AS BIGINT) AS age FROM orders),
v AS (SELECT unnest(range((SELECT min(age) FROM a), (SELECT max(age) + 1 FROM a))) AS value)
SELECT value, count(age) AS n FROM v LEFT JOIN a ON age = value GROUP BY value""",
)
def d7(t: Tables) -> DataFrame:
    return A.value_counts(S.conditions(t), "age")


FOLD_SQL = f"""{S.BASE} SELECT row_id, array_to_string(codes, ';') AS codes, label, CAST(age AS BIGINT) AS age FROM rec WHERE len(codes) > 0"""


@query("d8_fold_by_key", FOLD_SQL)
def d8(t: Tables) -> DataFrame:
    sets = R.symptom_sets(S.symptom_rows(t), "row_id", "code")
    return sets.join(S.conditions(t), "row_id").select("row_id", F.array_join("codes", ";").alias("codes"), "label", n64("age").alias("age"))


@query("d9_reduce_to_vector", FOLD_SQL)
def d9(t: Tables) -> DataFrame:
    return A.flag_union(S.symptom_rows(t), "row_id", "code", S.conditions(t)).select(
        "row_id", F.array_join("codes", ";").alias("codes"), "label", n64("age").alias("age")
    )


@query(
    "d10_group_constant",
    """SELECT l_orderkey AS row_id, max(l_linestatus) AS l_linestatus, max(l_returnflag) AS l_returnflag,
  CAST(count(DISTINCT l_linestatus) = 1 AND count(DISTINCT l_returnflag) = 1 AS INTEGER) AS consistent FROM lineitem GROUP BY 1""",
)
def d10(t: Tables) -> DataFrame:
    out = R.group_constant(t.lineitem, "l_orderkey", ["l_linestatus", "l_returnflag"])
    return out.withColumnRenamed("l_orderkey", "row_id")


@query(
    "d11_bit_mask",
    f"""{S.BASE} SELECT row_id, CAST(sum(CAST(1 AS BIGINT) << CAST(idx AS INTEGER)) AS BIGINT) AS mask FROM sym JOIN dic USING (code) GROUP BY 1""",
)
def d11(t: Tables) -> DataFrame:
    sets = R.with_indices(S.reported(t), "codes", S.dictionary(t))
    return sets.select("row_id", bit_mask(F.col("idx")).alias("mask"))


BRANDS = range(1, 26)


@query(
    "d12_flag_columns",
    f"{S.BASE} SELECT label, " + ", ".join(f"CAST(sum(CASE WHEN list_contains(codes, 'Brand#{i}') THEN 1 ELSE 0 END) AS BIGINT) AS f{i}" for i in BRANDS) + " FROM rec GROUP BY label",
)
def d12(t: Tables) -> DataFrame:
    flags = R.wide_flags(S.coded(t), "codes", [f"Brand#{i}" for i in BRANDS])
    return flags.groupBy("label").agg(*[F.sum(f"`Brand#{i}`").alias(f"f{i}") for i in BRANDS])


KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "d13_loop_pivot",
    "SELECT l_orderkey AS row_id, " + ", ".join(f"CAST(max(CASE WHEN p_type = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k.lower()}" for k in KINDS) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def d13(t: Tables) -> DataFrame:
    facts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return (
        facts.groupBy(F.col("l_orderkey").alias("row_id"))
        .pivot("p_type", list(KINDS))
        .agg(F.max(F.lit(1)))
        .select("row_id", *[n64(F.coalesce(n, F.lit(0))).alias(n.lower()) for n in KINDS])
    )


@query(
    "d14_declared_pivot",
    """SELECT l_orderkey AS row_id, CAST(max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS a,
  CAST(max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r
FROM lineitem GROUP BY 1""",
)
def d14(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        *[n64(F.max((flag == c).cast("int"))).alias(c.lower()) for c in ("A", "N", "R")]
    )


@query(
    "d15_last_value_pivot",
    """SELECT l_orderkey AS encounter, arg_max(l_quantity, l_linenumber * 1e9 + l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS a,
  arg_max(l_quantity, l_linenumber * 1e9 + l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS n,
  arg_max(l_quantity, l_linenumber * 1e9 + l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1""",
)
def d15(t: Tables) -> DataFrame:
    order = F.struct("l_linenumber", "l_extendedprice")
    wide = R.value_pivot(t.lineitem, "l_orderkey", "l_returnflag", "l_quantity", order, ["A", "N", "R"])
    return wide.select(F.col("l_orderkey").alias("encounter"), F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query(
    "d16_quantiles",
    """SELECT label, prob, round(value, 6) AS value FROM (
SELECT o_orderpriority AS label, unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS prob,
  unnest(quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0])) AS value FROM orders GROUP BY 1)""",
)
def d16(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("label"), "o_totalprice")
    return O.exact_quantiles(rows, ["label"], "o_totalprice", [0, 0.25, 0.5, 0.75, 1]).withColumn("value", F.round("value", 6))


@query(
    "d17_median_per_rank",
    """WITH m AS (SELECT l_linenumber AS rank, median(l_extendedprice) AS med FROM lineitem GROUP BY 1)
SELECT CAST(rank AS BIGINT) AS rank, round(med, 6) AS med, round((first_value(med) OVER (ORDER BY rank) - med) / first_value(med) OVER (ORDER BY rank), 6) AS drop FROM m""",
)
def d17(t: Tables) -> DataFrame:
    med = settle(O.exact_quantiles(t.lineitem, ["l_linenumber"], "l_extendedprice", [0.5]))
    # One row per rank.
    first = med.agg(F.min_by("value", "l_linenumber").alias("f")).scalar()
    return med.withColumn("f", first).select(
        n64("l_linenumber").alias("rank"), F.round("value", 6).alias("med"), F.round((F.col("f") - F.col("value")) / F.col("f"), 6).alias("drop")
    )


@query(
    "d18_box_stats",
    """WITH q AS (SELECT o_orderpriority AS label, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS med, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT label, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS med, round(any_value(q3), 6) AS q3,
  min(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM orders JOIN q ON o_orderpriority = label GROUP BY label""",
)
def d18(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("label"), "o_totalprice")
    box = A.box_stats(rows, ["label"], "o_totalprice")
    return box.select("label", *[F.round(c, 6).alias(c) for c in ("q1", "med", "q3")], "whisker_low", "whisker_high")


@query(
    "d19_extreme_rows",
    """SELECT arg_max(o_orderkey, o_totalprice) AS at_max, max(o_totalprice) AS max, arg_min(o_orderkey, o_totalprice) AS at_min, min(o_totalprice) AS min FROM orders""",
)
def d19(t: Tables) -> DataFrame:
    return A.extreme_rows(t.orders, F.col("o_orderkey"), F.col("o_totalprice"))


@query(
    "d20_most_common",
    """SELECT p_name AS item, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, item LIMIT 5""",
)
def d20(t: Tables) -> DataFrame:
    # Count per part before the names are joined.
    counts = t.lineitem.groupBy("l_partkey").agg(S.count_rows().alias("n"))
    named = counts.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_name").alias("item")).agg(F.sum("n").alias("n"))
    return named.orderBy(F.desc("n"), "item").limit(5)


@query(
    "d21_histogram",
    """SELECT CAST(floor(o_totalprice / 1000.0) * 1000 AS DOUBLE) AS bin_start, count(*) AS n FROM orders GROUP BY 1""",
)
def d21(t: Tables) -> DataFrame:
    return A.histogram(t.orders, "o_totalprice", 1000.0)


@query(
    "d22_list_lengths",
    f"""{S.BASE} SELECT source AS dataset, CAST(len(codes) AS BIGINT) AS length, count(*) AS n FROM rec GROUP BY ALL""",
)
def d22(t: Tables) -> DataFrame:
    return S.coded(t).groupBy(F.col("source").alias("dataset"), n64(F.size("codes")).alias("length")).agg(S.count_rows().alias("n"))


@query(
    "d22_mean_list_length",
    f"""{S.BASE} SELECT label, round(avg(len(codes)), 6) AS mean_length FROM rec GROUP BY label""",
)
def d22_mean(t: Tables) -> DataFrame:
    return S.coded(t).groupBy("label").agg(r6(F.avg(F.size("codes"))).alias("mean_length"))


@query(
    "d23_mean_of_metrics",
    """SELECT year(o_orderdate) AS dataset, o_orderstatus AS model, round(avg(o_totalprice), 6) AS price, round(avg(o_custkey), 6) AS cust FROM orders GROUP BY ALL""",
)
def d23(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("dataset"), F.col("o_orderstatus").alias("model")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("price"), F.round(F.avg("o_custkey"), 6).alias("cust")
    )


@query("d24_distinct_sorted", "SELECT DISTINCT p_brand AS code FROM part ORDER BY 1")
def d24(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("code")).distinct().orderBy("code")


@query(
    "d25_one_value_per_patient",
    """SELECT o_custkey AS patient, min(c_mktsegment) AS race FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def d25(t: Tables) -> DataFrame:
    seen = t.orders.groupBy(F.col("o_custkey").alias("patient")).agg(F.first("o_custkey").alias("k"))
    return seen.join(t.customer, F.col("k") == F.col("c_custkey")).groupBy("patient").agg(F.min("c_mktsegment").alias("race"))


RATES = f"""{S.BASE}, cls AS (SELECT label, count(*) AS n FROM rec GROUP BY label),
p AS (SELECT label, code, count(*) / any_value(n) AS rate FROM rec JOIN sym USING (row_id) JOIN cls USING (label) GROUP BY label, code)"""


@query("d26_rate_spread", f"{RATES} SELECT label, round(max(rate) - min(rate), 6) AS spread FROM p GROUP BY label")
def d26(t: Tables) -> DataFrame:
    rates = B.class_rates(S.coded(t), "label", "codes")
    return rates.groupBy("label").agg(r6(F.max("rate") - F.min("rate")).alias("spread"))


@query("d27_rates_above", f"{RATES} SELECT label, count(*) FILTER (WHERE rate > 0.15) AS above FROM p GROUP BY label")
def d27(t: Tables) -> DataFrame:
    rates = B.class_rates(S.coded(t), "label", "codes")
    return rates.groupBy("label").agg(F.count_if(F.col("rate") > 0.15).alias("above"))


@query(
    "d28_target_size",
    f"""WITH {CLASS_SETS}, s AS (SELECT count(*) AS n FROM own GROUP BY condition)
SELECT CAST(floor(avg(n)) AS BIGINT) AS mean_size, CAST(floor(floor(avg(n)) / 2) AS BIGINT) AS target FROM s""",
)
def d28(t: Tables) -> DataFrame:
    sizes = class_sets(t).groupBy("condition").agg(S.count_rows().alias("n"))
    mean = F.floor(F.avg("n"))
    return sizes.agg(n64(mean).alias("mean_size"), n64(F.floor(mean / 2)).alias("target"))
