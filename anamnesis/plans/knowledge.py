"""Knowledge-base tables: modules, definition sheets, attribute values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import maths as M
from ..functions import text as X
from ..operators import knowledge as J
from ..operators import ordering as O
from ..operators import sheets as H
from ..operators.sizes import store
from . import roles as S
from .registry import Tables, query
from .roles import n64, r6


def module_texts(t: Tables) -> DataFrame:
    """One module document per part, as JSON text: onset, symptom, guard, delay and end states."""
    p = t.part
    share = F.col("p_size") / 100
    none = F.lit(None)

    def state(kind, direct=none, distributed=none, conditional=none, complex_=none, codes=none, symptom=none, code=none):
        return F.struct(
            F.lit(kind).alias("type"),
            direct.cast("string").alias("direct_transition"),
            distributed.cast("array<struct<transition:string,distribution:double>>").alias("distributed_transition"),
            conditional.cast("array<struct<transition:string>>").alias("conditional_transition"),
            complex_.cast("array<struct<distributions:array<struct<transition:string,distribution:double>>>>").alias("complex_transition"),
            codes.cast("array<struct<system:string,code:string,display:string>>").alias("codes"),
            symptom.cast("string").alias("symptom"),
            code.cast("struct<system:string,code:string,display:string>").alias("symptom_code"),
        )

    def to(name, p_=None):
        fields = [F.lit(name).alias("transition")]
        if p_ is not None:
            fields.append(p_.alias("distribution"))
        return F.struct(*fields)

    codes = F.array(F.struct(F.lit("local").alias("system"), F.col("p_brand").alias("code"), F.col("p_type").alias("display")))
    code = F.struct(F.lit("sha224").alias("system"), F.lit("").alias("code"), F.col("p_name").alias("display"))
    states = F.create_map(
        F.lit("Start"), state("Initial", conditional=F.array(to("Onset"), to("Delay"))),
        F.lit("Onset"), state("ConditionOnset", distributed=F.array(to("Ache", share), to("Delay", 1 - share)), codes=codes),
        F.lit("Ache"), state("Symptom", direct=F.lit("Guard"), symptom=F.col("p_name"), code=code),
        F.lit("Guard"), state("Guard", complex_=F.array(F.struct(F.array(to("Onset", share), to("End", 1 - share)).alias("distributions")))),
        F.lit("Delay"), state("Delay", direct=F.lit("End")),
        F.lit("End"), state("Terminal"),
    )
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    return p.select(F.to_json(F.struct(name.alias("name"), states.alias("states"))).alias("value"))


@query(
    "j1_module_dimensions",
    """SELECT 'condition' AS kind, p_brand AS a, lower(arg_max(p_type, 'm' || p_partkey)) AS b FROM part GROUP BY p_brand
UNION ALL SELECT DISTINCT 'symptom', replace(p_name, ' ', '-'), NULL FROM part
UNION ALL SELECT DISTINCT 'bridge', p_brand, replace(p_name, ' ', '-') FROM part""",
)
def j1(t: Tables) -> DataFrame:
    conditions, symptoms, bridge = J.module_dimensions(J.module_states(module_texts(t)))
    names = symptoms.withColumnRenamed("name", "b")
    return (
        conditions.select(F.lit("condition").alias("kind"), F.col("code").alias("a"), F.col("name").alias("b"))
        .unionByName(symptoms.select(F.lit("symptom").alias("kind"), F.col("name").alias("a"), F.lit(None).cast("string").alias("b")))
        .unionByName(bridge.join(names, "code").select(F.lit("bridge").alias("kind"), F.col("condition").alias("a"), "b"))
    )


@query(
    "j2_state_edges",
    """WITH e AS (SELECT 'm' || p_partkey AS module, p_size / 100 AS p FROM part)
SELECT module, 'Start' AS state, 'Onset' AS next_state, 'conditional' AS kind, CAST(NULL AS DOUBLE) AS p FROM e
UNION ALL SELECT module, 'Start', 'Delay', 'conditional', NULL FROM e UNION ALL SELECT module, 'Onset', 'Ache', 'distributed', round(p, 6) FROM e
UNION ALL SELECT module, 'Onset', 'Delay', 'distributed', round(1 - p, 6) FROM e UNION ALL SELECT module, 'Ache', 'Guard', 'direct', 1.0 FROM e
UNION ALL SELECT module, 'Guard', 'Onset', 'complex', round(p, 6) FROM e UNION ALL SELECT module, 'Guard', 'End', 'complex', round(1 - p, 6) FROM e
UNION ALL SELECT module, 'Delay', 'End', 'direct', 1.0 FROM e""",
)
def j2(t: Tables) -> DataFrame:
    return J.state_edges(J.module_states(module_texts(t))).withColumn("p", F.round("p", 6))


@query(
    "j3_reachability",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'b' || o_custkey AS f, 's' || l_suppkey AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
w AS (SELECT DISTINCT f AS start, f AS node FROM e WHERE f LIKE 'b%' UNION SELECT start, t FROM w JOIN e ON node = f) SELECT start, node FROM w""",
)
def j3(t: Tables) -> DataFrame:
    """From each starting customer over suppliers to places; places and regions form cycles."""
    def tagged(mark, column):
        return F.concat(F.lit(mark), F.col(column).cast("string"))

    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # Read twice: for the edges and for the starts.
    buys = store(lines.select(tagged("b", "o_custkey").alias("f"), tagged("s", "l_suppkey").alias("t")), "buys")
    edges = (
        buys.unionByName(t.supplier.select(tagged("s", "s_suppkey").alias("f"), tagged("n", "s_nationkey").alias("t")))
        .unionByName(t.nation.select(tagged("n", "n_nationkey").alias("f"), tagged("r", "n_regionkey").alias("t")))
        .unionByName(t.nation.select(tagged("r", "n_regionkey").alias("f"), tagged("n", "n_nationkey").alias("t")))
    )
    return J.reachable(edges, buys, "f", "t", "f")


@query(
    "j4_first_seen",
    """SELECT p_name AS slug, min(p_partkey) AS row, arg_min(p_brand, p_partkey) AS description FROM part GROUP BY 1""",
)
def j4(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_name").alias("slug"), F.col("p_partkey").alias("row"), F.col("p_brand").alias("description"))
    return J.first_seen(rows, ["slug"], "row", ["row", "description"])


@query(
    "j5_first_non_null",
    """SELECT p_brand AS slug, arg_min(p_name, p_partkey) FILTER (WHERE p_size > 25) AS description, arg_min(p_type, p_partkey) FILTER (WHERE p_size < 20) AS remarks FROM part GROUP BY 1""",
)
def j5(t: Tables) -> DataFrame:
    rows = t.part.select(
        F.col("p_brand").alias("slug"),
        "p_partkey",
        F.when(F.col("p_size") > 25, F.col("p_name")).alias("description"),
        F.when(F.col("p_size") < 20, F.col("p_type")).alias("remarks"),
    )
    return J.first_non_null(rows, ["slug"], "p_partkey", ["description", "remarks"])


SHEET = """WITH e AS (SELECT event_id, event_type, user_id, value, last_value(CASE WHEN event_type = 'signup' THEN 'user ' || user_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS c FROM events)"""


def sheet(t: Tables) -> DataFrame:
    """Events as sheet rows: a signup heads a block, the rows below are its symptoms."""
    head = F.col("event_type") == "signup"
    rows = t.events.select(
        "event_id",
        F.when(head, F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("condition"),
        F.when(~head, F.col("event_type")).alias("symptom"),
        F.when(F.col("event_type") == "error", "often").otherwise(F.concat(F.floor("value").cast("string"), F.lit("%"))).alias("probability"),
    )
    filled = O.forward_fill(rows, "event_id", ["condition"])
    return J.sheet_definitions(filled)


@query(
    "j6_sheet_blocks",
    f"""{SHEET} SELECT c AS condition, event_type AS slug, count(*) AS n FROM e WHERE event_type <> 'signup' AND c IS NOT NULL GROUP BY ALL""",
)
def j6(t: Tables) -> DataFrame:
    return sheet(t).groupBy("condition", "slug").agg(S.count_rows().alias("n"))


@query(
    "j7_clean_definitions",
    f"""{SHEET} SELECT CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'kept' END AS part, count(*) AS n,
  coalesce(round(sum(CASE WHEN event_type <> 'error' THEN floor(value) END), 6), 0.0)::DOUBLE AS total FROM e WHERE event_type <> 'signup' AND c IS NOT NULL GROUP BY 1""",
)
def j7(t: Tables) -> DataFrame:
    good, bad = J.clean_definitions(sheet(t))

    def summary(df: DataFrame, part: str) -> DataFrame:
        return df.agg(S.count_rows().alias("n"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("total")).select(
            F.lit(part).alias("part"), "n", "total"
        )

    return summary(good, "kept").unionByName(summary(bad, "rejected"))


# Events as sheets of fifty rows and ten columns; in every other sheet location and intensity change places. Signups head
# blocks, views tell prevalences, the others symptoms.
LAYOUTS = {"a": H.ROLES, "b": (*H.ROLES[:6], "intensity", "location", *H.ROLES[8:])}
CELLS_SQL = """WITH r AS (SELECT event_id AS row, event_id // 50 AS sheet, event_type AS kind, user_id AS u, CAST(floor(value) AS BIGINT) AS v FROM events),
h AS (SELECT *, max(CASE WHEN kind = 'signup' THEN row END) OVER (ORDER BY row ROWS UNBOUNDED PRECEDING) AS head FROM r),
b AS (SELECT h.*, head AS block FROM h JOIN r ON r.row = h.head WHERE r.sheet = h.sheet AND h.kind <> 'signup'),
heads AS (SELECT row AS block, u, CASE WHEN u % 13 = 0 THEN '? ' ELSE '' END || 'User ' || u || ' (' || v || ')' AS condition FROM r WHERE kind = 'signup'),
sy AS (SELECT block, 'pain_' || kind || '_' || u % 3 AS slug, max(row) AS row FROM b WHERE kind <> 'view' GROUP BY ALL),
s AS (SELECT sy.*, kind, u, v FROM sy JOIN r USING (row))"""


def sheets(t: Tables) -> tuple[DataFrame, DataFrame]:
    kind, u, v = F.col("event_type"), F.col("user_id"), F.floor("value").cast("bigint")
    head, view = kind == "signup", kind == "view"
    text = {name: c.cast("string") for name, c in (("u", u), ("v", v), ("more", v + 10), ("third", u % 3), ("tens", u % 90))}
    percent = (
        F.when((kind == "error") & (u % 7 == 0), "often")
        .when(u % 3 == 0, F.concat(text["v"], F.lit(",5%")))
        .when(u % 3 == 1, F.concat(text["v"], F.lit("% - "), text["more"], F.lit("%")))
        .otherwise(F.concat(text["v"], F.lit("%")))
    )
    nature = F.when(u % 11 == 0, "sharp").when(u % 4 != 0, F.concat(F.lit("Sharp ("), text["v"], F.lit("%), dull pain("), text["tens"], F.lit(",5%)")))
    place = F.when(u % 17 == 0, "?!").when(u % 4 == 2, "Left  Arm").when(u % 4 == 3, F.concat(F.lit("chest ("), text["v"], F.lit("%); back: (1-"), text["tens"], F.lit("%)")))
    told = F.when(u % 3 == 0, F.concat(text["v"], F.lit(" years"))).when(u % 3 == 1, F.concat(F.lit("male ("), text["v"], F.lit("%), female ("), text["tens"], F.lit(",5%)"))).otherwise(F.lit("rare"))
    cells = {
        "condition": F.when(head, F.concat(F.when(u % 13 == 0, "? ").otherwise(""), F.lit("User "), text["u"], F.lit(" ("), text["v"], F.lit(")"))),
        "prevalence": F.when(view, F.when(u % 3 == 0, "Age prevalence").when(u % 3 == 1, " Gender").otherwise("Overall incidence")),
        "prevalence_value": F.when(view, told),
        "symptom": F.when(~head & ~view, F.concat(F.lit(" Pain  "), kind, F.lit(" "), text["third"])),
        "probability": percent, "nature": nature, "location": place, "intensity": F.lit("Mild"), "duration": F.when(u % 2 == 0, "2 Days"), "excitation": F.lit("  "),
    }
    first = F.floor(F.col("event_id") / 50) % 2 == 0
    placed = [F.when(first, cells[a]).otherwise(cells[b]) for a, b in zip(LAYOUTS["a"], LAYOUTS["b"])]
    sheet = F.floor(F.col("event_id") / 50)
    rows = t.events.select(F.when(first, "a").otherwise("b").alias("layout"), sheet.alias("sheet"), F.col("event_id").alias("row"), F.array(*placed).alias("cells"))
    return H.sheet_blocks(rows, LAYOUTS)


@query(
    "j6_whole_sheets",
    f"""{CELLS_SQL} SELECT block, slug, CASE WHEN kind = 'error' AND u % 7 = 0 THEN 'often' WHEN u % 3 = 0 THEN v || ',5%' WHEN u % 3 = 1 THEN v || '% - ' || (v + 10) || '%' ELSE v || '%' END AS probability,
  CASE WHEN u % 11 = 0 THEN 'sharp' WHEN u % 4 <> 0 THEN 'Sharp (' || v || '%), dull pain(' || u % 90 || ',5%)' ELSE 'n/a' END AS nature,
  CASE WHEN u % 17 = 0 THEN '?!' WHEN u % 4 = 2 THEN 'Left  Arm' WHEN u % 4 = 3 THEN 'chest (' || v || '%); back: (1-' || u % 90 || '%)' ELSE 'n/a' END AS location,
  'Mild' AS intensity, CASE WHEN u % 2 = 0 THEN '2 Days' ELSE 'n/a' END AS duration, 'n/a' AS excitation FROM s""",
)
def j6_whole(t: Tables) -> DataFrame:
    """Every symptom row of all sheets under its block, cell by cell."""
    return sheets(t)[1].select("block", "slug", "probability", *H.ATTRIBUTE_CELLS)


@query(
    "j6_block_attributes",
    f"""{CELLS_SQL}, p AS (SELECT block, u % 3 AS k, max(row) AS row FROM b WHERE kind = 'view' GROUP BY ALL),
q AS (SELECT block, max(CASE k WHEN 0 THEN v || ' years' END) AS age, max(CASE k WHEN 1 THEN 'male (' || v || '%), female (' || u % 90 || ',5%)' END) AS gender, max(CASE k WHEN 2 THEN 'rare' END) AS incidence
  FROM p JOIN r USING (row) GROUP BY block)
SELECT block, condition, age, gender, incidence FROM heads LEFT JOIN q USING (block)""",
)
def j6_attributes(t: Tables) -> DataFrame:
    return sheets(t)[0].select("block", "condition", "age", "gender", "incidence")


#: Blocks with what speaks against them, and the last good one of each name.
JUDGED = f"""{CELLS_SQL}, bad AS (SELECT block, 'probability' AS reason FROM s WHERE kind = 'error' AND u % 7 = 0 UNION SELECT block, 'nature' FROM s WHERE u % 11 = 0
  UNION SELECT block, 'location' FROM s WHERE u % 17 = 0 UNION SELECT block, 'condition' FROM heads WHERE u % 13 = 0),
good AS (SELECT 'user-' || u AS condition, max(block) AS block FROM heads WHERE block NOT IN (SELECT block FROM bad) GROUP BY 1)"""


def map_text(column: str) -> Column:
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


@query(
    "j7_whole_definitions",
    f"""{JUDGED} SELECT condition, slug, CASE WHEN u % 3 = 0 THEN v + 0.5 WHEN u % 3 = 1 THEN v + 10 ELSE v END::DOUBLE AS share,
  CASE WHEN u % 4 <> 0 THEN 'dull_pain=' || (u % 90 + 0.5)::DOUBLE || ';sharp=' || v::DOUBLE END AS nature,
  CASE WHEN u % 4 = 2 THEN 'left_arm=100.0' WHEN u % 4 = 3 THEN 'back=' || (u % 90)::DOUBLE || ';chest=' || v::DOUBLE END AS location,
  'mild' AS intensity, CASE WHEN u % 2 = 0 THEN '2 days' END AS duration, CAST(NULL AS VARCHAR) AS excitation FROM s JOIN good USING (block)""",
)
def j7_whole(t: Tables) -> DataFrame:
    """Cleaned definitions of the last good block of each condition: percentages, five attributes."""
    _, definitions, _ = H.clean_blocks(*sheets(t))
    return definitions.select("condition", "slug", "share", map_text("nature").alias("nature"), map_text("location").alias("location"), "intensity", "duration", "excitation")


@query(
    "j7_conditions",
    f"""{JUDGED}, p AS (SELECT block, u % 3 AS k, max(row) AS row FROM b WHERE kind = 'view' GROUP BY ALL)
SELECT condition, block, max(CASE k WHEN 0 THEN v || ' years' END) AS age, max(CASE k WHEN 1 THEN v END)::DOUBLE AS male, max(CASE k WHEN 1 THEN u % 90 + 0.5 END)::DOUBLE AS female,
  max(CASE k WHEN 2 THEN 'rare' END) AS incidence FROM good LEFT JOIN p USING (block) LEFT JOIN r USING (row) GROUP BY ALL""",
)
def j7_conditions(t: Tables) -> DataFrame:
    conditions, _, _ = H.clean_blocks(*sheets(t))
    return conditions.select("condition", "block", "age", "male", "female", "incidence")


@query(
    "j7_quarantine",
    f"{JUDGED} SELECT block, condition AS name, string_agg(reason, ',' ORDER BY reason) AS reasons FROM bad JOIN heads USING (block) GROUP BY ALL",
)
def j7_quarantine(t: Tables) -> DataFrame:
    """Blocks that are left out, with every reason."""
    return H.clean_blocks(*sheets(t))[2].select("block", "name", F.array_join("reasons", ",").alias("reasons"))


def attribute_rows(t: Tables) -> DataFrame:
    """(row_id, symptom, attribute, value, seq): four attribute reports per symptom row."""
    facts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    reports = F.create_map(
        F.lit("nature"), F.col("l_returnflag"),
        F.lit("vas"), F.col("l_linestatus"),
        F.lit("duration"), F.col("l_linenumber").cast("string"),
        F.lit("location"), F.col("p_type"),
    )
    return facts.select(
        F.col("l_orderkey").alias("row_id"),
        F.col("p_brand").alias("symptom"),
        (F.col("l_linenumber") * 1e9 + F.col("l_extendedprice")).alias("seq"),
        F.explode(reports).alias("attribute", "value"),
    )


ATTRS = """f AS (SELECT l_orderkey AS row_id, p_brand AS symptom, l_returnflag AS nature, l_linestatus AS vas, l_linenumber::VARCHAR AS duration, p_type AS location, l_linenumber * 1e9 + l_extendedprice AS place FROM lineitem JOIN part ON l_partkey = p_partkey),
long AS (SELECT row_id, symptom, 'nature' AS attribute, nature AS value, place FROM f UNION ALL SELECT row_id, symptom, 'vas', vas, place FROM f UNION ALL SELECT row_id, symptom, 'duration', duration, place FROM f UNION ALL SELECT row_id, symptom, 'location', location, place FROM f),
vals AS (SELECT symptom, attribute, list_sort(list_distinct(list(value) || ['0-None'])) AS v FROM long GROUP BY ALL),
lists AS (SELECT symptom, any_value(v) FILTER (attribute = 'nature') AS n, any_value(v) FILTER (attribute = 'vas') AS i, any_value(v) FILTER (attribute = 'duration') AS d, any_value(v) FILTER (attribute = 'location') AS l FROM vals GROUP BY 1)"""


@query("j8_attribute_values", f"WITH {ATTRS} SELECT symptom, attribute, array_to_string(v, ',') AS value_list FROM vals")
def j8(t: Tables) -> DataFrame:
    return J.attribute_values(attribute_rows(t)).select("symptom", "attribute", F.array_join("values", ",").alias("value_list"))


@query(
    "j9_combination_codes",
    f"""WITH {ATTRS}, x AS (SELECT symptom, unnest(n) AS n, i, d, l FROM lists), y AS (SELECT symptom, n, unnest(i) AS i, d, l FROM x), z AS (SELECT symptom, n, i, unnest(d) AS d, l FROM y), u AS (SELECT symptom, n, i, d, unnest(l) AS l FROM z)
SELECT symptom, concat_ws(';', n, i, d, l) AS combo, row_number() OVER (PARTITION BY symptom ORDER BY n, i, d, l) AS code FROM u""",
)
def j9(t: Tables) -> DataFrame:
    return J.combination_codes(J.attribute_values(attribute_rows(t))).withColumn("code", n64("code"))


def reductions(t: Tables) -> DataFrame:
    """Value replacements per symptom: the promo location of the first brands counts as small."""
    return t.part.where(F.col("p_brand").isin("Brand#1", "Brand#2")).select(
        F.col("p_brand").alias("symptom"), F.lit("PROMO").alias("value"), F.lit("SMALL").alias("reduced")
    ).distinct()


@query(
    "j10_value_reduction",
    f"""WITH {ATTRS} SELECT symptom, CASE WHEN symptom IN ('Brand#1', 'Brand#2') AND value = 'PROMO' THEN 'SMALL' ELSE value END AS value, count(*) AS n FROM long WHERE attribute = 'location' GROUP BY ALL""",
)
def j10(t: Tables) -> DataFrame:
    places = attribute_rows(t).where("attribute = 'location'").groupBy("symptom", "value").agg(S.count_rows().alias("n"))
    reduced = places.join(reductions(t), ["symptom", "value"], "left")
    return reduced.groupBy("symptom", F.coalesce("reduced", "value").alias("value")).agg(F.sum("n").alias("n"))


CODED = f"""WITH {ATTRS}, p AS (SELECT row_id, symptom, arg_max(nature, place) AS n0, arg_max(vas, place) AS i0, arg_max(duration, place) AS d0, arg_max(location, place) AS l0 FROM f GROUP BY ALL),
c AS (SELECT row_id, p.symptom, (((list_position(n, n0) - 1) * len(i) + list_position(i, i0) - 1) * len(d) + list_position(d, d0) - 1) * len(l)
  + list_position(l, CASE WHEN p.symptom IN ('Brand#1', 'Brand#2') AND l0 = 'PROMO' AND list_contains(l, 'SMALL') THEN 'SMALL' ELSE l0 END) AS code FROM p JOIN lists USING (symptom))"""


def coded_rows(t: Tables) -> DataFrame:
    rows = attribute_rows(t)
    return J.encode_attributes(rows, J.attribute_values(rows), "row_id", "seq", reductions(t))


@query("j11_attribute_records", f"{CODED} SELECT row_id, symptom, CAST(code AS BIGINT) AS code FROM c")
def j11(t: Tables) -> DataFrame:
    return coded_rows(t)


@query("j11_sparse_text")
def j11_text(t: Tables) -> DataFrame:
    return J.sparse_attribute_rows(coded_rows(t), "row_id")


@query(
    "j12_attribute_encoders",
    """SELECT 'nature' AS attribute, value, CAST(row_number() OVER (ORDER BY value) + 1 AS INTEGER) AS code FROM (SELECT DISTINCT l_returnflag AS value FROM lineitem)
UNION ALL SELECT 'vas', value, CAST(row_number() OVER (ORDER BY value) + 1 AS INTEGER) FROM (SELECT DISTINCT l_linestatus AS value FROM lineitem) UNION ALL SELECT 'vas', 'other', 1""",
)
def j12(t: Tables) -> DataFrame:
    nature = J.attribute_encoder(t.lineitem, "l_returnflag", False).select(F.lit("nature").alias("attribute"), "value", "code")
    vas = J.attribute_encoder(t.lineitem, "l_linestatus", True).select(F.lit("vas").alias("attribute"), "value", "code")
    return nature.unionByName(vas)


@query(
    "j13_attributes_by_symptom",
    """SELECT p_name AS symptom, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS locations, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS natures FROM part GROUP BY 1""",
)
def j13(t: Tables) -> DataFrame:
    def joined(c):
        return F.array_join(F.array_sort(F.collect_set(c)), ",")

    return t.part.groupBy(F.col("p_name").alias("symptom")).agg(joined("p_type").alias("locations"), joined("p_brand").alias("natures"))


GIVEN = """g AS (SELECT p_name AS condition, p_brand AS symptom, CASE WHEN p_size > 25 THEN p_type END AS value, max(p_size)::DOUBLE AS pct FROM part GROUP BY ALL),
al AS (SELECT DISTINCT p_brand AS symptom, p_type AS value FROM part), k AS (SELECT condition, symptom, count(value) AS nv FROM g GROUP BY ALL)"""


@query(
    "j14_fill_values",
    f"""WITH {GIVEN}, w AS (SELECT condition, symptom, value FROM g WHERE value IS NOT NULL UNION SELECT k.condition, k.symptom, al.value FROM k JOIN al USING (symptom) UNION SELECT condition, symptom, 'other' FROM k)
SELECT w.condition, w.symptom, w.value, coalesce(g.pct, CASE WHEN w.value = 'other' AND nv = 0 THEN 90.0 ELSE 5.0 END)::DOUBLE AS pct
FROM w JOIN k USING (condition, symptom) LEFT JOIN g ON g.condition = w.condition AND g.symptom = w.symptom AND g.value = w.value""",
)
def j14(t: Tables) -> DataFrame:
    given = t.part.groupBy(
        F.col("p_name").alias("condition"),
        F.col("p_brand").alias("symptom"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("value"),
    ).agg(F.max("p_size").cast("double").alias("pct"))
    allowed = t.part.select(F.col("p_brand").alias("symptom"), F.col("p_type").alias("value"))
    return J.fill_values(given, allowed, True)


@query(
    "j15_location_family",
    """WITH m AS (SELECT r_name AS main, n_name AS part FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, r_name FROM region)
SELECT c_custkey AS id, f.part AS location FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN m ON m.part = n_name JOIN m f ON f.main = m.main""",
)
def j15(t: Tables) -> DataFrame:
    parts = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("main"), F.col("n_name").alias("part"))
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("location"))
    return J.location_family(places, parts)


@query(
    "j16_sampling_shares",
    """WITH o AS (SELECT c_nationkey AS condition, c_mktsegment AS grp, count(*) FILTER (WHERE c_acctbal > 5000)::DOUBLE AS odds, 50.0::DOUBLE AS probability FROM customer GROUP BY ALL),
p AS (SELECT condition, grp, CASE WHEN odds > 0 THEN odds / (odds + 1) ELSE probability / 100 END AS p FROM o)
SELECT condition, grp, round(p / sum(p) OVER (PARTITION BY condition), 6) AS p FROM p
UNION ALL SELECT k, g, v FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT 100 + r_regionkey FROM region), (VALUES ('male', 0.5::DOUBLE), ('female', 0.25::DOUBLE)) d(g, v)
WHERE k NOT IN (SELECT condition FROM p)""",
)
def j16(t: Tables) -> DataFrame:
    odds = (
        t.customer.groupBy(F.col("c_nationkey").alias("condition"), F.col("c_mktsegment").alias("grp"))
        .agg(F.count_if(F.col("c_acctbal") > 5000).cast("double").alias("odds"), F.lit(50.0).alias("probability"))
    )
    # Regions are conditions that no customer tells anything of.
    keys = t.nation.select(F.col("n_nationkey").alias("condition")).unionByName(t.region.select((F.col("r_regionkey") + 100).alias("condition")))
    # The shares a condition without given sexes gets.
    return J.sampling_shares(odds, {"male": 0.5, "female": 0.25}, keys).withColumn("p", r6(F.col("p")))


@query(
    "j19_planted_faults",
    """WITH f AS (SELECT 'm' || p_partkey AS module, p_size / 100 AS p, CASE p_size % 4 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 4.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM part),
e AS (SELECT module, 'Onset' AS state, p * k AS p FROM f UNION ALL SELECT module, 'Onset', 1 - p FROM f UNION ALL SELECT module, 'Guard', p FROM f UNION ALL SELECT module, 'Guard', (1 - p) * k FROM f
  UNION ALL SELECT module, 'Ache', 1.0 FROM f UNION ALL SELECT module, 'Delay', 1.0 FROM f)
SELECT module, state, round(sum(p), 6) AS total, count(*) FILTER (WHERE p < 0 OR p > 1) AS outside, CAST(abs(sum(p) - 1) > 1e-6 AS INTEGER) AS off FROM e GROUP BY ALL""",
)
def j19_planted(t: Tables) -> DataFrame:
    """Transitions of three quarters of the modules are made too large or negative; the audit tells which and how."""
    size = t.part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("m"), (F.col("p_size") % 4).alias("k"))
    edges = J.state_edges(J.module_states(module_texts(t))).join(size, F.col("module") == F.col("m"))
    factor = F.when(F.col("k") == 0, 1.5).when(F.col("k") == 1, 4.0).when(F.col("k") == 2, -1.0).otherwise(1.0)
    bent = ((F.col("state") == "Onset") & (F.col("next_state") == "Ache")) | ((F.col("state") == "Guard") & (F.col("next_state") == "End"))
    audit = J.probability_audit(edges.withColumn("p", F.when(bent, F.col("p") * factor).otherwise(F.col("p"))), ["module", "state"])
    return audit.withColumn("total", r6(F.col("total")))


@query("j17_hashed_probabilities")
def j17(t: Tables) -> DataFrame:
    shares = t.part.groupBy("p_type", "p_name").agg(F.max("p_size").alias("probability"))
    return shares.select(X.hash_key(F.col("p_type")).alias("condition"), X.hash_key(F.col("p_name")).alias("symptom"), "probability")


@query(
    "j18_category_distance",
    f"""{CODED}, b AS (SELECT row_id, symptom, concat_ws(';', n0, i0, d0, l0) AS combo FROM p)
SELECT row_id, symptom, (split_part(combo, ';', 1) <> 'N')::INT + (split_part(combo, ';', 2) <> 'O')::INT + (split_part(combo, ';', 3) <> '1')::INT + (split_part(combo, ';', 4) <> 'SMALL')::INT AS distance FROM b""",
)
def j18(t: Tables) -> DataFrame:
    picked = attribute_rows(t).groupBy("row_id", "symptom").agg(
        *[F.max_by("value", F.when(F.col("attribute") == a, F.col("seq"))).alias(a) for a in J.ATTRIBUTES]
    )
    combo = F.concat_ws(";", *J.ATTRIBUTES)
    return picked.select("row_id", "symptom", M.mismatches(F.split(combo, ";"), F.split(F.lit("N;O;1;SMALL"), ";")).alias("distance"))


@query(
    "j19_probability_audit",
    """SELECT 'm' || p_partkey AS module, state, 1.0::DOUBLE AS total, 0::BIGINT AS outside, 0 AS off FROM part, (VALUES ('Onset'), ('Ache'), ('Guard'), ('Delay')) s(state)""",
)
def j19(t: Tables) -> DataFrame:
    audit = J.probability_audit(J.state_edges(J.module_states(module_texts(t))), ["module", "state"])
    return audit.withColumn("total", r6(F.col("total")))
