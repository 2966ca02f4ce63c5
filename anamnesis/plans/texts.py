"""Lists, keys, slugs, regular expressions and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators import knowledge as J
from ..operators import records as R
from . import roles as S
from .registry import Tables, query
from .roles import n64


@query(
    "h1_split_list",
    f"{S.BASE} SELECT row_id, CAST(len(codes) AS BIGINT) AS n, codes[1] AS head FROM rec",
)
def h1(t: Tables) -> DataFrame:
    text = R.compact_rows(S.coded(t)).select("row_id", "SYMPTOMS")
    codes = X.code_list(F.col("SYMPTOMS"))
    return text.select("row_id", n64(F.size(codes)).alias("n"), F.get(codes, 0).alias("head"))


@query(
    "h2_codes_to_indices",
    f"{S.BASE} SELECT row_id, array_to_string(list_sort(list(idx)), ',') AS symptoms FROM sym JOIN dic USING (code) GROUP BY 1",
)
def h2(t: Tables) -> DataFrame:
    rows = R.looked_up(S.reported(t), "row_id", "codes", S.dictionary(t), "idx", "idx")
    return rows.select("row_id", F.array_join(F.array_sort("idx").cast("array<string>"), ",").alias("symptoms"))


@query(
    "h3_codes_to_names",
    f"""{S.BASE}, nm AS (SELECT p_brand AS code, min(p_name) AS name FROM part GROUP BY 1)
SELECT row_id, string_agg(name, ';' ORDER BY code) AS names FROM sym JOIN nm USING (code) GROUP BY 1""",
)
def h3(t: Tables) -> DataFrame:
    names = t.part.groupBy(F.col("p_brand").alias("code")).agg(F.min("p_name").alias("name"))
    rows = R.looked_up(S.reported(t), "row_id", "codes", names, "name", "names")
    return rows.select("row_id", F.array_join("names", ";").alias("names"))


@query(
    "h4_offset_indices",
    f"{S.BASE} SELECT row_id, CAST(sum(idx + 5) AS BIGINT) AS total FROM sym JOIN dic USING (code) GROUP BY 1",
)
def h4(t: Tables) -> DataFrame:
    text = h2(t)
    moved = X.index_list(F.col("symptoms"), 5)
    return text.select("row_id", n64(F.aggregate(moved, F.lit(0), lambda a, v: a + v)).alias("total"))


SLUG = r"replace(replace(replace(regexp_replace(lower({0}), '[ \t\n\f\r\v]+', '-', 'g'), '''', '-'), '(', ''), ')', '')"


@query("h5_slugify", f"SELECT doc_id, md5({SLUG.format('text')}) AS slug_md5, CAST(length({SLUG.format('text')}) AS BIGINT) AS n FROM documents")
def h5(t: Tables) -> DataFrame:
    slug = t.documents.select("doc_id", X.slugify(F.col("text")).alias("slug"))
    return slug.select("doc_id", F.md5("slug").alias("slug_md5"), n64(F.length("slug")).alias("n"))


@query("h6_symptom_key", "SELECT p_partkey AS item, regexp_replace(trim(lower(p_name)), '\\s+', '_', 'g') AS name FROM part")
def h6(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("item"), X.symptom_key(F.col("p_name")).alias("name"))


@query("h7_sha224_keys")
def h7(t: Tables) -> DataFrame:
    return t.part.select("p_name").distinct().select("p_name", X.hash_key(F.col("p_name")).alias("key"))


KINDS = ["en", "de", "fr", "es"]


@query(
    "h8_url_slugs",
    "SELECT page_id, "
    + ", ".join(f"CASE WHEN regexp_matches(url, '^https?://[^/]+/{k}/') THEN regexp_extract(url, '^https?://[^/]+/{k}/(.*)$', 1) END AS {k}" for k in KINDS)
    + " FROM pages",
)
def h8(t: Tables) -> DataFrame:
    return t.pages.select("page_id", *[X.url_slug(F.col("url"), f"https?://[^/]+/{k}/").alias(k) for k in KINDS])


@query("h9_likelihood", "SELECT p_partkey AS item, p_retailprice AS likelihood, CAST(NULL AS DOUBLE) AS bad FROM part")
def h9(t: Tables) -> DataFrame:
    cell = F.concat(F.col("p_retailprice").cast("string"), F.lit("x"))
    return t.part.select(F.col("p_partkey").alias("item"), X.likelihood(cell).alias("likelihood"), X.likelihood(F.col("p_name")).alias("bad"))


@query(
    "h10_percent_range",
    """SELECT p_partkey AS item, greatest(p_size + 0.5, length(p_name))::DOUBLE AS share FROM part""",
)
def h10(t: Tables) -> DataFrame:
    cell = F.concat_ws("", F.col("p_size").cast("string"), F.lit(",5 - "), F.length("p_name").cast("string"), F.lit("%"))
    return t.part.select(F.col("p_partkey").alias("item"), X.percent_max(cell).alias("share"))


@query(
    "h11_named_percentages",
    """SELECT p_partkey AS item, unnest([replace(p_name, ' ', '_'), lower(p_type)]) AS name, unnest([p_size::DOUBLE, 3.5::DOUBLE]) AS share FROM part""",
)
def h11(t: Tables) -> DataFrame:
    cell = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit("%) "), F.lower("p_type"), F.lit(" (3,5%)"))
    shares = t.part.select(F.col("p_partkey").alias("item"), F.explode(X.named_percentages(cell)))
    return shares.select("item", F.col("key").alias("name"), F.col("value").alias("share"))


@query(
    "h11_locations",
    """SELECT p_partkey AS item, unnest(CASE WHEN p_size % 3 = 0 THEN [replace(p_name, ' ', '_')] ELSE [replace(p_name, ' ', ''), lower(p_type)] END) AS place,
  unnest(CASE p_size % 3 WHEN 0 THEN [100.0::DOUBLE] WHEN 1 THEN [p_size::DOUBLE, 3.5::DOUBLE] ELSE [(p_size + 10)::DOUBLE, 3.5::DOUBLE] END) AS share FROM part""",
)
def h11_locations(t: Tables) -> DataFrame:
    """A bare place counts 100; others have a share, of a range the upper end, between signs of all kinds."""
    size, upto = F.col("p_size").cast("string"), (F.col("p_size") + 10).cast("string")
    rest = F.concat(F.lit("%) ; "), F.lower("p_type"), F.lit(": (3,5 %)"))
    cell = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(
        F.concat("p_name", F.lit(" ("), F.when(F.col("p_size") % 3 == 1, size).otherwise(F.concat(size, F.lit("% - "), upto)), rest)
    )
    shares = t.part.select(F.col("p_partkey").alias("item"), F.explode(X.locations(cell)))
    return shares.select("item", F.col("key").alias("place"), F.col("value").alias("share"))


@query("h12_gender_shares", "SELECT p_partkey AS item, p_size::DOUBLE AS male, (100 - p_size)::DOUBLE AS female FROM part")
def h12(t: Tables) -> DataFrame:
    size, rest = F.col("p_size").cast("string"), (100 - F.col("p_size")).cast("string")
    cell = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("males: "), size, F.lit("%, females "), rest, F.lit("%"))).otherwise(
        F.concat(F.lit("("), size, F.lit("% male, "), rest, F.lit("% female)"))
    )
    return t.part.select(F.col("p_partkey").alias("item"), X.gender_shares(cell).alias("s")).select("item", "s.male", "s.female")


def attribute_names(t: Tables) -> DataFrame:
    """Items named ``symptom`` or ``symptom-nlice-attribute-value``."""
    plain = X.slugify(F.col("p_name"))
    coded = F.concat_ws("-", plain, F.lit("nlice"), F.lower("p_type"), F.lower(F.regexp_replace("p_brand", "#", "")))
    return t.part.select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") > 25, coded).otherwise(plain).alias("name"))


NAMES = """nm AS (SELECT p_partkey AS item, replace(p_name, ' ', '-') AS base, lower(p_type) AS attr, lower(replace(p_brand, '#', '')) AS val, p_size > 25 AS coded FROM part)"""


@query(
    "h13_attribute_split",
    f"WITH {NAMES} SELECT item, base AS symptom, CASE WHEN coded THEN attr END AS attribute, CASE WHEN coded THEN val END AS value FROM nm",
)
def h13(t: Tables) -> DataFrame:
    return attribute_names(t).select("item", X.attribute_parts(F.col("name")).alias("p")).select("item", "p.symptom", "p.attribute", "p.value")


@query(
    "h14_first_pair",
    "SELECT CAST(length(p_name) AS INTEGER) AS index, p_size AS value, count(*) AS n FROM part GROUP BY ALL",
)
def h14(t: Tables) -> DataFrame:
    cell = F.concat(F.length("p_name").cast("string"), F.lit("|"), F.col("p_size").cast("string"), F.lit(","))
    pair = t.part.select(X.first_pair(cell).alias("p"))
    return pair.groupBy(F.col("p.index").alias("index"), F.col("p.value").alias("value")).agg(S.count_rows().alias("n"))


@query(
    "h15_run_parameters",
    """SELECT p_partkey AS item, p_size::VARCHAR AS depth, CASE WHEN p_type <> 'PROMO' THEN lower(p_type) END AS leaf FROM part""",
)
def h15(t: Tables) -> DataFrame:
    leaf = F.when(F.col("p_type") == "PROMO", "None").otherwise(F.lower("p_type"))
    name = F.concat(F.lit("forest depth_"), F.col("p_size").cast("string"), F.lit("-leaf_"), leaf)
    return t.part.select(F.col("p_partkey").alias("item"), X.run_parameter(name, "depth").alias("depth"), X.run_parameter(name, "leaf").alias("leaf"))


@query(
    "h16_initials",
    """SELECT p_partkey AS item, upper(p_name[1]) || lower(p_name[2]) || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2]) AS short FROM part""",
)
def h16(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("item"), X.initials(F.col("p_name")).alias("short"))


@query("h17_keyword", "SELECT doc_id, source FROM documents WHERE text ILIKE '%license%'")
def h17(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").rlike("(?i)license")).select("doc_id", "source")


@query(
    "h18_yes_no_questions",
    """SELECT l_orderkey AS question FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2 AND bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'N')""",
)
def h18(t: Tables) -> DataFrame:
    answers = t.lineitem.groupBy(F.col("l_orderkey").alias("question")).agg(F.collect_set("l_returnflag").alias("answers"))
    return answers.where(X.is_yes_no(F.col("answers"), "r", "n")).select("question")


@query(
    "h19_question_mapping",
    """SELECT event_id, CASE WHEN user_id < 50 THEN 'cough' WHEN user_id < 100 THEN 'sore-throat' END AS symptom,
  CASE WHEN event_type = 'signup' THEN 'duration' ELSE 'nature' END AS kind, CASE WHEN event_type = 'signup' THEN 'unit' ELSE 'multi' END AS format FROM events""",
)
def h19(t: Tables) -> DataFrame:
    file = F.when(F.col("user_id") < 50, "a").when(F.col("user_id") < 100, "b")
    questions = t.events.withColumn("file", file)
    return J.question_kinds(questions, "event_type", "signup", "file", {"a": "cough", "b": "sore-throat"}).select(
        "event_id", "symptom", "kind", "format"
    )


@query("h20_nested_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def h20(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    "h21_rule_descriptor",
    """SELECT o_orderkey AS rule, (CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'null' END) || '-' || c_mktsegment || '-' ||
  (CASE WHEN o_orderstatus = 'P' THEN '>=' || c_nationkey::VARCHAR || ' <' || (c_nationkey + 10)::VARCHAR ELSE '<' || c_nationkey::VARCHAR END) || '-' ||
  (CASE WHEN o_orderpriority = '1-URGENT' THEN 'Attribute' ELSE '' END) AS descriptor
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def h21(t: Tables) -> DataFrame:
    both = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("string")
    no_parts = F.lit(None).cast("array<struct<condition_type:string,operator:string,quantity:int>>")

    def rule(kind, gender=none, race=none, operator=none, quantity=None, parts=no_parts):
        return F.struct(
            F.lit(kind).alias("condition_type"),
            gender.alias("gender"),
            race.alias("race"),
            operator.alias("operator"),
            (F.lit(None).cast("int") if quantity is None else quantity).alias("quantity"),
            parts.alias("conditions"),
        )

    nation = F.col("c_nationkey")

    def bound(op, q):
        return F.struct(F.lit("Age").alias("condition_type"), F.lit(op).alias("operator"), q.alias("quantity"))

    span = rule("And", parts=F.array(bound(">=", nation), bound("<", nation + 10)))
    rules = F.array(
        F.when(F.col("o_orderstatus") == "F", rule("Gender", gender=F.col("o_orderstatus"))),
        rule("Race", race=F.col("c_mktsegment")),
        F.when(F.col("o_orderstatus") == "P", span).otherwise(rule("Age", operator=F.lit("<"), quantity=nation)),
        F.when(F.col("o_orderpriority") == "1-URGENT", rule("Attribute")),
    )
    return both.select(F.col("o_orderkey").alias("rule"), J.rule_descriptor(F.array_compact(rules)).alias("descriptor"))


@query("h22_plain_names", f"WITH {NAMES} SELECT item, base AS name FROM nm WHERE NOT coded")
def h22(t: Tables) -> DataFrame:
    return attribute_names(t).where(~F.col("name").contains(X.ATTRIBUTE_MARK))
