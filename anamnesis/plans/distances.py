"""Distances between classes and drift between datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import distances as D
from ..operators import evaluation as V
from ..operators import rates as B
from ..operators.sizes import settle
from . import roles as S
from .evaluation import scored
from .joins import PLACE_SETS, place_sets
from .models import FIRST_SOURCE, nb_sql
from .registry import Tables, query
from .roles import n64, r6

WIDTH = "(SELECT count(*) FROM dic)"
PAIRS = f"""{S.BASE}, cls AS (SELECT nation, count(*) AS n FROM rec GROUP BY 1), p AS (SELECT nation, code, count(*) / any_value(n) AS p FROM rec JOIN sym USING (row_id) JOIN cls USING (nation) GROUP BY 1, 2),
nz AS (SELECT nation, sum(p) AS s, sum(p * p) AS q, count(*) AS k FROM p GROUP BY 1),
d AS (SELECT x.nation AS a, y.nation AS b, coalesce(sum(pa.p * pb.p), 0) AS dot, count(pb.p) AS common, any_value(x.s) AS sa, any_value(y.s) AS sb, any_value(x.q) AS qa, any_value(y.q) AS qb, any_value(x.k) AS ka, any_value(y.k) AS kb
  FROM nz x JOIN nz y ON x.nation < y.nation JOIN p pa ON pa.nation = x.nation LEFT JOIN p pb ON pb.nation = y.nation AND pb.code = pa.code GROUP BY 1, 2)"""


def class_pairs(t: Tables) -> DataFrame:
    rates = settle(B.class_rates(S.records(t), "nation", "codes"))
    width = S.dictionary(t).agg(S.count_rows()).scalar()
    return D.class_distances(rates, "nation", "code", "rate", width)


def one(t: Tables, name: str) -> DataFrame:
    return class_pairs(t).select(n64("a").alias("a"), n64("b").alias("b"), r6(F.col(name)).alias("d"))


IDS = "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b,"
# Sums of whole numbers: hits and rows of each class, products of hits.
HITS = f"""{S.BASE}, cls AS (SELECT nation, count(*) AS n FROM rec GROUP BY 1), h AS (SELECT nation, code, count(*) AS k FROM rec JOIN sym USING (row_id) GROUP BY 1, 2),
s AS (SELECT nation, sum(k)::HUGEINT AS h, any_value(n)::HUGEINT AS n FROM h JOIN cls USING (nation) GROUP BY 1),
d AS (SELECT x.nation AS a, y.nation AS b, any_value(x.h) AS ha, any_value(y.h) AS hb, any_value(x.n) AS na, any_value(y.n) AS nb, coalesce(sum(p.k * q.k), 0)::HUGEINT AS dot
  FROM s x JOIN s y ON x.nation < y.nation JOIN h p ON p.nation = x.nation LEFT JOIN h q ON q.nation = y.nation AND q.code = p.code GROUP BY 1, 2),
f AS (SELECT a, b, ha * nb + hb * na - 2 * dot AS top, na * nb * {WIDTH} AS below FROM d)"""


@query("o1_variability_index", f"{HITS} {IDS} ((2000000 * top + below) // (2 * below))::DOUBLE / 1000000 AS d FROM f")
def o1(t: Tables) -> DataFrame:
    hits = settle(B.class_rates(S.records(t), "nation", "codes"))
    width = S.dictionary(t).agg(S.count_rows()).scalar()
    found = D.variability(hits, "nation", "code", width)
    return found.select(n64("a").alias("a"), n64("b").alias("b"), F.col("variability").alias("d"))


@query("o2_cosine_pairs", f"{PAIRS} {IDS} round(1 - dot / sqrt(qa) / sqrt(qb), 6) AS d FROM d")
def o2(t: Tables) -> DataFrame:
    return one(t, "cosine")


# Nations and the parts that they ordered: no nation has all.
SETS = f"""WITH {PLACE_SETS}, width AS (SELECT count(*) AS w FROM part), k AS (SELECT condition, count(*) AS k FROM own GROUP BY 1),
c AS (SELECT a.condition AS a, b.condition AS b, count(*) AS n FROM own a JOIN own b ON a.code = b.code AND a.condition < b.condition GROUP BY ALL),
d AS (SELECT x.condition AS a, y.condition AS b, round((x.k + y.k - 2 * coalesce(n, 0)) / w, 6) AS d FROM k x JOIN k y ON x.condition < y.condition
  LEFT JOIN c ON c.a = x.condition AND c.b = y.condition CROSS JOIN width)"""


def set_pairs(t: Tables) -> DataFrame:
    width = t.part.agg(S.count_rows()).scalar()
    ones = place_sets(t).withColumn("w", F.lit(1.0))
    return D.class_distances(ones, "condition", "code", "w", width).select(n64("a").alias("a"), n64("b").alias("b"), r6(F.col("hamming")).alias("d"))


@query("o3_hamming_pairs", f"{SETS} {IDS} d FROM d")
def o3(t: Tables) -> DataFrame:
    return set_pairs(t)


@query("o4_euclidean_pairs", f"{PAIRS} {IDS} round(sqrt(greatest(0, qa + qb - 2 * dot)), 6) AS d FROM d")
def o4(t: Tables) -> DataFrame:
    return one(t, "euclidean")


@query("o5_symmetric_matrix", f"{SETS} {IDS} d FROM d UNION ALL SELECT CAST(b AS BIGINT), CAST(a AS BIGINT), d FROM d")
def o5(t: Tables) -> DataFrame:
    return D.symmetric(set_pairs(t))


def drift_sql(p: str = "p", sizes: str = "cls") -> str:
    """Class rates per dataset, their KL divergence and Wasserstein distance from dataset F."""
    return f"""{sizes} AS (SELECT source, label, count(*) AS n FROM rec GROUP BY 1, 2),
{p} AS (SELECT source, label, code, count(*) / any_value(n) AS p FROM rec JOIN sym USING (row_id) JOIN {sizes} USING (source, label) GROUP BY ALL),
vr AS (SELECT DISTINCT source FROM {p} WHERE source <> 'F'),
j AS (SELECT vr.source, b.label, b.code, b.p AS p, coalesce(q.p, 0) AS q FROM vr CROSS JOIN (SELECT * FROM {p} WHERE source = 'F') b
  LEFT JOIN {p} q ON q.source = vr.source AND q.label = b.label AND q.code = b.code),
t AS (SELECT source, label, sum(p) AS sp, sum(q) AS sq, count(*) FILTER (WHERE q = 0) AS missing FROM j GROUP BY ALL),
kl AS (SELECT j.source, j.label, any_value(missing) AS missing, sum(p / sp * ln((p / sp) / (q / sq))) AS kl FROM j JOIN t USING (source, label) WHERE q > 0 GROUP BY ALL),
u AS (SELECT source, label, p, row_number() OVER (PARTITION BY source, label ORDER BY p) AS i FROM j),
w AS (SELECT source, label, q, row_number() OVER (PARTITION BY source, label ORDER BY q) AS i FROM j),
wd AS (SELECT u.source, u.label, avg(abs(p - q)) AS d FROM u JOIN w USING (source, label, i) GROUP BY ALL)"""


DRIFT = f"{S.BASE}, {drift_sql()}"


def rates(t: Tables) -> DataFrame:
    return settle(B.class_rates(S.coded(t), "label", "codes", ["source"]))


@query("o6_kl_base_support", f"{DRIFT} SELECT source, label, missing, round(CASE WHEN missing = 0 THEN kl END, 6) AS kl FROM kl")
def o6(t: Tables) -> DataFrame:
    return D.drift(rates(t), "source", "F", "label", "code", "rate").select("source", "label", "missing", r6(F.col("kl_base")).alias("kl"))


@query("o7_kl_variant_support", f"{DRIFT} SELECT source, label, round(kl, 6) AS kl FROM kl")
def o7(t: Tables) -> DataFrame:
    return D.drift(rates(t), "source", "F", "label", "code", "rate").select("source", "label", r6(F.col("kl_variant")).alias("kl"))


# Drift over parts: every dataset has codes that another lacks.
PART_DRIFT = """WITH own AS (SELECT DISTINCT o_orderstatus AS source, o_orderpriority AS label, l_partkey::VARCHAR AS code, l_orderkey AS row_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cls AS (SELECT o_orderstatus AS source, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT source, label, code, count(*) / any_value(n) AS p FROM own JOIN cls USING (source, label) GROUP BY ALL),
vr AS (SELECT DISTINCT source FROM p WHERE source <> 'F'), b AS (SELECT vr.source, label, code, p FROM p JOIN vr ON p.source = 'F'), v AS (SELECT source, label, code, p AS q FROM p WHERE source <> 'F'),
j AS (SELECT coalesce(b.source, v.source) AS source, coalesce(b.label, v.label) AS label, coalesce(p, 0) AS p, coalesce(q, 0) AS q
  FROM b FULL JOIN v ON b.source = v.source AND b.label = v.label AND b.code = v.code),
t AS (SELECT source, label, sum(p) FILTER (WHERE q > 0) AS sp, sum(q) AS sq, count(*) FILTER (WHERE q = 0) AS missing FROM j GROUP BY ALL)"""


def part_rates(t: Tables) -> DataFrame:
    """(source, label, code, rate): share of a class's orders that have the part."""
    orders = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("label"))
    sizes = orders.groupBy("source", "label").agg(S.count_rows().alias("n"))
    lines = t.lineitem.select("l_orderkey", F.col("l_partkey").cast("string").alias("code")).distinct()
    hits = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("source", "label", "code").agg(S.count_rows().alias("hits"))
    return settle(hits.join(sizes, ["source", "label"]).withColumn("rate", F.col("hits") / F.col("n")))


@query(
    "o7_variant_codes",
    f"{PART_DRIFT} SELECT j.source, j.label, any_value(missing) AS missing, round(sum(CASE WHEN p > 0 AND q > 0 THEN p / sp * ln((p / sp) / (q / sq)) END), 6) AS kl FROM j JOIN t USING (source, label) GROUP BY ALL",
)
def o7_codes(t: Tables) -> DataFrame:
    """Both sides renormalised on the codes of the variant, those that the base lacks included."""
    return D.drift(part_rates(t), "source", "F", "label", "code", "rate").select("source", "label", "missing", r6(F.col("kl_variant")).alias("kl"))


@query("o8_wasserstein", f"{DRIFT} SELECT source, label, round(d, 6) AS d FROM wd")
def o8(t: Tables) -> DataFrame:
    return D.wasserstein(rates(t), "source", "F", "label", "code", "rate").select("source", "label", r6(F.col("distance")).alias("d"))


@query("o9_drift_summary", f"{DRIFT} SELECT source, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std FROM wd GROUP BY source")
def o9(t: Tables) -> DataFrame:
    far = D.wasserstein(rates(t), "source", "F", "label", "code", "rate")
    out = D.drift_summary(far, "source", ["distance"])
    return out.select("source", r6(F.col("distance_mean")).alias("mean"), r6(F.col("distance_std")).alias("std"))


NB = nb_sql(label="label", train=FIRST_SOURCE)


@query(
    "o10_drift_and_accuracy",
    f"""{NB}, pd AS (SELECT row_id, source, max(CASE WHEN label = cand THEN rank END) AS own_rank FROM pr GROUP BY ALL),
acc AS (SELECT source, avg(CASE WHEN own_rank = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM pd GROUP BY 1), {drift_sql("dp", "dcls")}
SELECT source, round(avg(d), 6) AS drift, round(any_value((SELECT a FROM acc WHERE source = 'F') - a), 6) AS loss FROM wd JOIN acc USING (source) GROUP BY source""",
)
def o10(t: Tables) -> DataFrame:
    far = D.drift_summary(D.wasserstein(rates(t), "source", "F", "label", "code", "rate"), "source", ["distance"])
    acc = settle(V.accuracy(scored(t, "label", train=FIRST_SOURCE), "label", ["source"], (1,)))
    base = acc.where("source = 'F'").select("top_1").scalar()
    loss = acc.withColumn("loss", base - F.col("top_1"))
    return far.join(loss, "source").select("source", r6(F.col("distance_mean")).alias("drift"), r6(F.col("loss")).alias("loss"))
