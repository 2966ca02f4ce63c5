"""Injected, perturbed, extended and resampled variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import rates as B
from ..operators import variants as V
from ..operators.sizes import store
from . import roles as S
from .registry import Tables, query
from .roles import n64, r6

DEFS = """defs AS (SELECT o_custkey AS condition, p_name AS code, least(95, 3 * count(*))::DOUBLE AS probability FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
VOCAB = "vocab AS (SELECT DISTINCT code FROM defs), conds AS (SELECT DISTINCT condition FROM defs)"
SHARE = {
    "mean": "CAST(trunc(avg(probability)) AS INTEGER)",
    "max": "CAST(trunc(max(probability)) AS INTEGER)",
    "min": "CAST(trunc(min(probability)) AS INTEGER)",
    "half_mean": "CAST(ceil(0.5::DOUBLE * avg(probability)) AS INTEGER)",
}


def definitions(t: Tables) -> DataFrame:
    """A definition table: (condition, code, probability in percent). Customers are the conditions, so that each lacks some codes."""
    return (
        t.lineitem.select("l_orderkey", "l_partkey")
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("condition"), F.col("p_name").alias("code"))
        .agg(F.least(F.lit(95), 3 * S.count_rows()).cast("double").alias("probability"))
    )


def _connected_sql(mode: str) -> str:
    return f"""WITH {DEFS}, {VOCAB},
edges AS (SELECT a.code AS own, b.code AS code, count(*) AS n FROM defs a JOIN defs b ON a.condition = b.condition AND a.code <> b.code GROUP BY ALL),
s AS (SELECT d.condition, e.code, sum(e.n) AS s FROM defs d JOIN edges e ON d.code = e.own GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY s DESC, code) AS place FROM s WHERE (condition, code) NOT IN (SELECT (condition, code) FROM defs)),
p AS (SELECT condition, {SHARE[mode]}::DOUBLE AS probability FROM defs GROUP BY condition)
SELECT condition, code, probability FROM r JOIN p USING (condition) WHERE place <= 5"""


def _hashed_sql(mode: str) -> str:
    return f"""WITH {DEFS}, {VOCAB},
a AS (SELECT condition, code FROM conds CROSS JOIN vocab WHERE (condition, code) NOT IN (SELECT (condition, code) FROM defs)),
r AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY md5(concat_ws('-', '11', condition::VARCHAR, code)), code) AS place FROM a),
p AS (SELECT condition, {SHARE[mode]}::DOUBLE AS probability FROM defs GROUP BY condition)
SELECT condition, code, probability FROM r JOIN p USING (condition) WHERE place <= 5"""


def _register_modes() -> None:
    for mode in SHARE:
        query(f"k1_inject_connected_{mode}", _connected_sql(mode))(lambda t, m=mode: V.inject_connected(definitions(t), m))
        query(f"k2_inject_hashed_{mode}", _hashed_sql(mode))(lambda t, m=mode: V.inject_hashed(definitions(t), m, seed=11))
    for pct in (10, 30, 70):
        sql = f"""WITH {DEFS}, m AS (SELECT condition, code, (100.0::DOUBLE + CASE WHEN md5(concat_ws('-', '4', condition::VARCHAR, code))[1] >= '8' THEN {pct}.0::DOUBLE ELSE -{pct}.0::DOUBLE END) * probability / 100 AS p FROM defs)
SELECT condition, code, round(CASE WHEN p <= 1 THEN 5.0::DOUBLE WHEN p >= 100 THEN 95.0::DOUBLE ELSE p END, 6) AS probability FROM m"""
        query(f"k3_perturb_{pct}", sql)(lambda t, p=pct: V.perturb(definitions(t), p, 4).withColumn("probability", r6(F.col("probability"))))


_register_modes()


@query(
    "k4_extend_absent",
    f"""WITH {DEFS}, {VOCAB} SELECT condition, code, coalesce(probability, 1.0::DOUBLE) AS probability FROM conds CROSS JOIN vocab LEFT JOIN defs USING (condition, code)""",
)
def k4(t: Tables) -> DataFrame:
    return V.extend_absent(definitions(t))


@query("k4_least_share", f"WITH {DEFS} SELECT min(probability) AS least FROM defs WHERE probability > 1")
def k4_least(t: Tables) -> DataFrame:
    return V.least_known_share(definitions(t))


def _resample_sql(weighted: bool) -> str:
    rank = "-ln(u) / w" if weighted else "u"
    return f"""{S.BASE}, w AS (SELECT label, code, count(*)::DOUBLE AS w FROM rec JOIN sym USING (row_id) GROUP BY ALL),
d AS (SELECT row_id, len(codes) AS n, w.code AS code, w, (('0x' || md5(concat_ws('-', '9', row_id::VARCHAR, w.code))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM rec JOIN w USING (label)),
r AS (SELECT row_id, n, code, row_number() OVER (PARTITION BY row_id ORDER BY {rank}, code) AS place FROM d)
SELECT row_id, string_agg(code, ';' ORDER BY code) AS codes FROM r WHERE place <= n GROUP BY row_id"""


def _resampled(t: Tables, weighted: bool) -> DataFrame:
    rows = store(S.reported(t).select("row_id", "label", "codes"), "records")
    rates = B.class_rates(rows, "label", "codes").select("label", "code", F.col("hits").cast("double").alias("weight"))
    out = V.resample(rows, rates, "row_id", "label", "codes", 9, weighted)
    return out.select("row_id", F.array_join("codes", ";").alias("codes"))


@query("k5_resample_weighted", _resample_sql(True))
def k5(t: Tables) -> DataFrame:
    return _resampled(t, True)


@query("k5_resample_uniform", _resample_sql(False))
def k5_uniform(t: Tables) -> DataFrame:
    return _resampled(t, False)


@query(
    "k6_minimum_symptoms",
    f"{S.BASE} SELECT k.k AS least, count(*) AS n, round(avg(len(codes)), 6) AS mean_codes FROM rec JOIN range(1, 6) k(k) ON len(codes) >= k GROUP BY 1",
)
def k6(t: Tables) -> DataFrame:
    """All five variants from one pass: sizes are counted, then summed from the largest down."""
    sizes = S.reported(t).groupBy(F.size("codes").alias("s")).agg(S.count_rows().alias("n"))
    held = sizes.withColumn("least", F.explode(F.sequence(F.lit(1), F.least(F.lit(5), "s"))))
    return held.groupBy(n64("least").alias("least")).agg(
        F.sum("n").alias("n"), r6(F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("mean_codes")
    )
