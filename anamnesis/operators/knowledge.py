"""Knowledge-base files (modules, definition sheets, attribute values) as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.codes import lookup
from ..functions.text import hash_key, percent_max, slugify, symptom_key
from ..session import scratch_path
from .sizes import settle, small_side, store

# Order and neutral value of the four coded attributes, and the fill-in percentages.
ATTRIBUTES = ["nature", "vas", "duration", "location"]
NEUTRAL = "0-None"
INCLUDE_PERCENT = 5.0
OTHER_PERCENT = 90.0


def question_kinds(
    questions: DataFrame, slide: str, duration_slide: str, file: str, symptoms: Mapping[str, str]
) -> DataFrame:
    """What a dialogue question asks for: the duration slide is a number, all others a choice."""
    lasting = F.lower(F.col(slide)) == duration_slide
    return questions.withColumns(
        {
            "symptom": lookup(F.col(file), symptoms),
            "kind": F.when(lasting, "duration").otherwise("nature"),
            "format": F.when(lasting, "unit").otherwise("multi"),
        }
    )


def rule_descriptor(rules: Column) -> Column:
    """``gender-race-age-others`` of a transition rule.

    ``rules`` is an array of structs (condition_type, gender, race, operator, quantity,
    conditions); a conjunction of ages alone gives an age span, any other nested rule counts
    under others.
    """

    def last(kind: str, field: str) -> Column:
        found = F.filter(rules, lambda r: r["condition_type"] == kind)
        return F.coalesce(F.try_element_at(found, F.lit(-1))[field], F.lit("null"))

    def bound(r: Column) -> Column:
        return F.concat(r["operator"], r["quantity"].cast("string"))

    def span(r: Column) -> Column:
        parts = r["conditions"]
        only_ages = F.forall(parts, lambda p: p["condition_type"] == "Age")
        return F.when(only_ages, F.array_join(F.transform(parts, bound), " "))

    def nested(r: Column) -> Column:
        return (r["condition_type"] == "And") & r["conditions"].isNotNull()

    ages = F.array_compact(
        F.transform(rules, lambda r: F.when(r["condition_type"] == "Age", bound(r)).when(nested(r), span(r)))
    )
    age = F.coalesce(F.try_element_at(ages, F.lit(-1)), F.lit("null"))

    def other(r: Column) -> Column:
        kind = r["condition_type"]
        odd = F.filter(r["conditions"], lambda p: p["condition_type"] != "Age")
        inner = F.try_element_at(odd, F.lit(1))["condition_type"]
        return F.when(nested(r), inner).when(~kind.isin("Gender", "Race", "Age"), kind)

    others = F.array_join(F.array_compact(F.transform(rules, other)), "")
    return F.concat_ws("-", last("Gender", "gender"), last("Race", "race"), age, others)


# -- state modules --------------------------------------------------------------------------

STATE = (
    "type string, direct_transition string, "
    "distributed_transition array<struct<transition:string,distribution:double>>, "
    "conditional_transition array<struct<transition:string>>, "
    "complex_transition array<struct<distributions:array<struct<transition:string,distribution:double>>>>, "
    "codes array<struct<system:string,code:string,display:string>>, symptom string, "
    "symptom_code struct<system:string,code:string,display:string>"
)
STATE_STRUCT = f"struct<{', '.join(f.replace(' ', ':', 1) for f in STATE.split(', '))}>"
MODULE = f"struct<name:string,states:map<string,{STATE_STRUCT}>>"


def module_states(texts: DataFrame, text: str = "value") -> DataFrame:
    """(module, state, s): one row per state of each module document."""
    parsed = texts.select(F.from_json(text, MODULE).alias("m"))
    return parsed.select(F.col("m.name").alias("module"), F.explode("m.states").alias("state", "s"))


def module_dimensions(states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conditions (code, name), symptoms (code, name) and their bridge within a module."""
    onset = states.where(F.col("s.type") == "ConditionOnset").select(
        "module", F.get("s.codes", 0)["code"].alias("condition"), F.get("s.codes", 0)["display"].alias("display")
    )
    shown = states.where(F.col("s.type") == "Symptom").select("module", slugify(F.col("s.symptom_code.display")).alias("name"))
    conditions = onset.groupBy(F.col("condition").alias("code")).agg(slugify(F.max_by("display", "module")).alias("name"))
    symptoms = shown.select(hash_key(F.col("name")).alias("code"), "name").distinct()
    bridge = onset.select("module", "condition").join(shown, "module").select("condition", hash_key(F.col("name")).alias("code")).distinct()
    return conditions, symptoms, bridge


def state_edges(states: DataFrame) -> DataFrame:
    """(module, state, next_state, kind, p): edges of all four transition kinds, in one pass."""
    edge = "array<struct<kind:string,next_state:string,p:double>>"

    def listed(kind: str, items: Column, p) -> Column:
        return F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x["transition"].alias("next_state"), p(x).alias("p"))).cast(edge)

    direct = F.when(
        F.col("s.direct_transition").isNotNull(),
        F.array(F.struct(F.lit("direct").alias("kind"), F.col("s.direct_transition").alias("next_state"), F.lit(1.0).alias("p"))),
    ).cast(edge)
    nested = F.flatten(F.transform("s.complex_transition", lambda c: c["distributions"]))
    every = [
        direct,
        listed("distributed", F.col("s.distributed_transition"), lambda x: x["distribution"]),
        listed("conditional", F.col("s.conditional_transition"), lambda x: F.lit(None).cast("double")),
        listed("complex", nested, lambda x: x["distribution"]),
    ]
    empty = F.array().cast(edge)
    merged = F.concat(*[F.coalesce(e, empty) for e in every])
    return states.select("module", "state", F.explode(merged).alias("e")).select("module", "state", "e.next_state", "e.kind", "e.p")


def reachable(edges: DataFrame, starts: DataFrame, source: str, target: str, start: str) -> DataFrame:
    """(start, node): all nodes that can be reached from each start, the start included.

    Breadth first to the fixpoint; each round follows only the pairs found last. The edges and each round's
    pairs are written once, so neither the plan nor a lost executor replays the earlier ones. A round takes the
    edges that leave its nodes, and meets only those known pairs whose node one of them enters; both are
    broadcast where their counted sizes allow. Cycles end because a known pair is not followed again.
    """
    spark = starts.sparkSession
    steps = store(edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).distinct(), "edges")
    own = starts.select(F.col(start).alias("start")).distinct()
    node = own.select("start").union(steps.select("_to")).schema[0].dataType
    path, rounds = scratch_path(spark, "reached"), []

    def kept(pairs: DataFrame) -> DataFrame:
        rounds.append(f"{path}/{len(rounds)}")
        pairs = pairs.withColumn("node", F.col("node").cast(node))
        pairs.write.parquet(rounds[-1])
        return spark.read.schema(pairs.schema).parquet(rounds[-1])

    def small(df: DataFrame) -> DataFrame:
        return small_side(df, text_columns=[name for name, kind in df.dtypes if kind == "string"])

    found = kept(own.withColumn("node", F.col("start")))
    # Edges are distinct, so are the pairs of the first round.
    first = steps.join(small(found.select("start")), F.col("_from") == F.col("start"))
    fresh = kept(first.where(~F.col("_from").eqNullSafe(F.col("_to"))).select("start", F.col("_to").alias("node")))
    while True:
        found = spark.read.schema(found.schema).parquet(*rounds)
        nodes = settle(fresh.select("node").distinct())
        if nodes.isEmpty():
            return found
        leaving = store(steps.join(small(nodes), F.col("_from") == F.col("node"), "left_semi"), "leaving")
        marked = small(leaving)
        after = fresh.join(marked, F.col("node") == F.col("_from")).select("start", F.col("_to").cast(node).alias("node")).distinct()
        entered = leaving.select(F.col("_to").cast(node).alias("node")).distinct()
        met = found.join(entered if marked is leaving else F.broadcast(entered), "node", "left_semi")
        fresh = kept(after.join(met, ["start", "node"], "left_anti"))


# -- definition sheets ----------------------------------------------------------------------


def repeated_groups(columns: Sequence[str], width: int, names: Sequence[str], valid) -> Column:
    """First valid group of a row whose columns repeat every ``width``: a struct of ``names``, or NULL."""
    groups = [
        F.struct(*[F.trim(F.col(columns[i + k])).alias(n) for k, n in enumerate(names)])
        for i in range(0, len(columns) - len(names) + 1, width)
    ]
    return F.get(F.filter(F.array(*groups), valid), 0)


def first_seen(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """First row per key in the given order."""
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in columns])


def first_non_null(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """First value per key and column that is not NULL, in the given order."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def sheet_definitions(rows: DataFrame) -> DataFrame:
    """Symptom rows under their condition header: needs condition_filled, symptom, probability columns."""
    return rows.where(F.col("symptom").isNotNull() & F.col("condition_filled").isNotNull()).select(
        F.col("condition_filled").alias("condition"), symptom_key(F.col("symptom")).alias("slug"), "probability"
    )


def clean_definitions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions with parsed percentages, and the rejected rows."""
    parsed = rows.withColumn("share", percent_max(F.col("probability")))
    return parsed.where(F.col("share").isNotNull()), parsed.where(F.col("share").isNull())


# -- coded attributes -----------------------------------------------------------------------


def attribute_values(rows: DataFrame) -> DataFrame:
    """Distinct values per symptom and attribute, the neutral one included: (symptom, attribute, values).

    ``rows`` holds (symptom, attribute, value); the value sets are bounded by the definitions.
    """
    seen = rows.select("symptom", "attribute", "value").where(F.col("attribute").isNotNull()).distinct()
    neutral = rows.select("symptom").distinct().select(
        "symptom", F.explode(F.array(*[F.lit(a) for a in ATTRIBUTES])).alias("attribute"), F.lit(NEUTRAL).alias("value")
    )
    both = seen.unionByName(neutral).distinct()
    return both.groupBy("symptom", "attribute").agg(F.array_sort(F.collect_set("value")).alias("values"))


def combination_codes(values: DataFrame) -> DataFrame:
    """1-based code of every attribute combination of a symptom: (symptom, combo, code).

    The code follows the product order (last attribute fastest), so it is computed from the
    positions in the value lists and needs no numbering pass.
    """
    lists = values.groupBy("symptom").agg(*[F.max(F.when(F.col("attribute") == a, F.col("values"))).alias(a) for a in ATTRIBUTES])
    out = lists
    for a in ATTRIBUTES:
        out = out.select("*", F.posexplode(a).alias(f"_p_{a}", f"_v_{a}"))
    code: Column = F.lit(0)
    for a in ATTRIBUTES:
        code = code * F.size(a) + F.col(f"_p_{a}")
    return out.select("symptom", F.concat_ws(";", *[f"_v_{a}" for a in ATTRIBUTES]).alias("combo"), (code + 1).alias("code"))


def attribute_places(values: DataFrame, reductions: DataFrame | None = None) -> DataFrame:
    """(symptom, attribute, value, place): position of every value in its list, replaced values at the place of their replacement."""
    places = values.select("symptom", "attribute", F.posexplode("values").alias("place", "value"))
    if reductions is None:
        return places
    moved = reductions.join(places.withColumnRenamed("value", "reduced").withColumnRenamed("place", "_to"), ["symptom", "reduced"])
    moved = moved.select("symptom", "attribute", "value", "_to")
    both = places.join(moved, ["symptom", "attribute", "value"], "full")
    return both.select("symptom", "attribute", "value", F.coalesce("_to", "place").alias("place"))


def encode_attributes(rows: DataFrame, values: DataFrame, key: str, order: str, reductions: DataFrame | None = None) -> DataFrame:
    """One ``code`` per record and symptom from its attribute rows; the last value in order wins.

    ``rows`` holds (key, symptom, attribute, value, order) with a numeric order, ``reductions``
    (symptom, value, reduced). Values become list positions before the fold, which then keeps
    only numbers per record and symptom and can hash-aggregate on the map side.
    """
    values = settle(values)
    places = settle(attribute_places(values, reductions))
    placed = rows.join(small_side(places), ["symptom", "attribute", "value"])
    picked = placed.groupBy(key, "symptom").agg(
        *[F.max_by("place", F.when(F.col("attribute") == a, F.col(order))).alias(a) for a in ATTRIBUTES]
    )
    neutral = F.array_position("values", NEUTRAL) - 1
    shape = values.withColumn("_z", neutral).groupBy("symptom").agg(
        *[F.max(F.when(F.col("attribute") == a, F.size("values"))).alias(f"_k_{a}") for a in ATTRIBUTES],
        *[F.max(F.when(F.col("attribute") == a, F.col("_z"))).alias(f"_z_{a}") for a in ATTRIBUTES],
    )
    joined = picked.join(small_side(settle(shape)), "symptom")
    code: Column = F.lit(0)
    for a in ATTRIBUTES:
        code = code * F.col(f"_k_{a}") + F.coalesce(a, f"_z_{a}")
    return joined.select(key, "symptom", (code + 1).cast("bigint").alias("code"))


def sparse_attribute_rows(coded: DataFrame, key: str) -> DataFrame:
    """``hash|code;hash|code`` per record, in symptom order."""
    item = F.struct("symptom", F.concat_ws("|", hash_key(F.col("symptom")), F.col("code").cast("string")).alias("t"))
    items = coded.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("i"))
    return items.select(key, F.array_join(F.transform("i", lambda x: x["t"]), ";").alias("SYMPTOMS"))


def attribute_encoder(values: DataFrame, column: str, other: bool) -> DataFrame:
    """(value, code): sorted values from 2 up; ``other`` is 1 where the attribute reserves it."""
    distinct = values.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    # One row per attribute value.
    codes = distinct.withColumn("code", F.row_number().over(Window.orderBy("value")) + 1)
    if other:
        head = codes.sparkSession.range(1).select(F.lit("other").alias("value"), F.lit(1).alias("code"))
        codes = head.unionByName(codes)
    return codes


def fill_values(given: DataFrame, allowed: DataFrame, other: bool) -> DataFrame:
    """Give every (condition, symptom) all allowed values; what was missing gets 5 %.

    ``given`` holds (condition, symptom, value, pct) with a NULL value where a pair has none;
    with ``other`` such a pair gets 90 % for ``other``. ``allowed`` holds (symptom, value).
    """
    sets = allowed.groupBy("symptom").agg(F.collect_set("value").alias("_all"))
    once = given.groupBy("condition", "symptom", "value").agg(F.max("pct").alias("pct"))
    folded = once.groupBy("condition", "symptom").agg(
        F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "pct"))))).alias("_m")
    )
    start = F.col("_m")
    if other:
        start = F.when(F.size("_m") == 0, F.create_map(F.lit("other"), F.lit(OTHER_PERCENT))).otherwise(F.col("_m"))
    joined = folded.join(sets, "symptom", "left").withColumn("_s", start)
    wanted = F.array_union(F.map_keys("_s"), F.coalesce("_all", F.array().cast("array<string>")))
    if other:
        wanted = F.array_union(wanted, F.array(F.lit("other")))
    return joined.select("condition", "symptom", "_s", F.explode(wanted).alias("value")).select(
        "condition", "symptom", "value", F.coalesce(F.try_element_at("_s", F.col("value")), F.lit(INCLUDE_PERCENT)).alias("pct")
    )


def location_family(locations: DataFrame, parts: DataFrame) -> DataFrame:
    """Each (id, location) with the main part it belongs to and all siblings: (id, location).

    ``parts`` holds (main, part); an unknown location stands for itself.
    """
    members = parts.select("main", "part").unionByName(parts.select("main", F.col("main").alias("part"))).distinct()
    families = members.groupBy("main").agg(F.collect_set("part").alias("_f"))
    homes = settle(members.groupBy("part").agg(F.min("main").alias("main")).join(families, "main"))
    joined = locations.distinct().join(small_side(homes, 1024), F.col("location") == F.col("part"), "left")
    return joined.select("id", F.explode(F.coalesce("_f", F.array("location"))).alias("location")).distinct()


def sampling_shares(odds: DataFrame, default: Mapping[str, float], keys: DataFrame) -> DataFrame:
    """(condition, grp, p): odds or percentages per condition normalised to 1, the default where none are given.

    ``odds`` holds (condition, grp, odds, probability); ``keys`` all conditions. The default is
    passed on as it is, also where it does not sum to 1.
    """
    raw = odds.select(
        "condition", "grp", F.when(F.col("odds") > 0, F.col("odds") / (F.col("odds") + 1)).otherwise(F.col("probability") / 100).alias("p")
    )
    total = F.sum("p").over(Window.partitionBy("condition"))
    given = raw.select("condition", "grp", (F.col("p") / total).alias("p"))
    pairs = [F.lit(x) for item in default.items() for x in item]
    rest = keys.join(raw, "condition", "left_anti").select("condition", F.explode(F.create_map(*pairs)).alias("grp", "p"))
    return given.unionByName(rest)


def probability_audit(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the transition probabilities per rule, and whether it or any of them is out of range."""
    p = F.col("p")
    return edges.where(p.isNotNull()).groupBy(*keys).agg(
        F.sum(p).alias("total"),
        F.count_if((p < 0) | (p > 1)).alias("outside"),
        (F.abs(F.sum(p) - 1) > 1e-6).cast("int").alias("off"),
    )
