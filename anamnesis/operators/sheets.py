"""Definition sheets: rows of cells by position, read as blocks of conditions with their symptoms.

A sheet has a layout: which position holds which of ten roles. A row with a condition heads a block; the rows below it
hold a prevalence (age, gender, overall) and its value, a symptom with its cells, or both. Blocks end where
the next one begins or the sheet ends. Sheets may be of any length: a row finds its header by a forward fill over
buckets, not by reading the sheet in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import gender_shares, locations, named_percentages, percent_max, slugify, symptom_key
from .ordering import forward_fill
from .sizes import settle, store

# The roles of a sheet in the order of its usual layout, and the mark of an empty cell.
ROLES = ("condition", "prevalence", "prevalence_value", "symptom", "probability", "nature", "location", "intensity", "duration", "excitation")
NOT_GIVEN = "n/a"
ATTRIBUTE_CELLS = ("nature", "location", "intensity", "duration", "excitation")
_NAME = r"^([A-Za-z0-9\-\s]+)"


def by_role(rows: DataFrame, layouts: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns named by role from ``cells``; blank cells are NULL, rows without any cell go.

    ``layouts`` names the roles of each ``layout`` in the order of its positions; rows of other layouts go.
    """
    columns = {}
    for role in ROLES:
        value = F.lit(None).cast("string")
        for name, layout in layouts.items():
            if role in layout:
                value = F.when(F.col("layout") == name, F.trim(F.get("cells", list(layout).index(role)))).otherwise(value)
        columns[role] = F.when(value != "", value)
    known = rows.where(F.col("layout").isin(list(layouts))).select("sheet", "row", *[c.alias(role) for role, c in columns.items()])
    return known.where(F.coalesce(*ROLES).isNotNull())


def sheet_blocks(rows: DataFrame, layouts: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Blocks (block, condition, age, gender, incidence) and symptoms (block, slug, probability and the five attribute cells).

    ``rows`` has ``layout``, ``sheet``, ``row`` (a number through all sheets, one sheet after the other) and ``cells``. A block is named by the row of
    its header; what else stands in that row is not read. Of a prevalence or symptom that a block names twice the last
    one stands; rows before the first header of their sheet are left out.
    """
    head = F.col("condition").isNotNull()
    named = by_role(rows, layouts).withColumns({"_head": F.when(head, F.col("row")), "_sheet": F.when(head, F.col("sheet"))})
    filled = forward_fill(store(named, "sheet"), "row", ["_head", "_sheet"])
    below = filled.where(F.col("condition").isNull() & (F.col("_sheet_filled").eqNullSafe(F.col("sheet")) & F.col("_head_filled").isNotNull())).withColumnRenamed("_head_filled", "block")
    below = store(below.drop("_head", "_sheet", "_sheet_filled"), "sheet_rows")
    kind = F.lower("prevalence")
    kinds = F.when(kind.contains("age"), "age").when(kind.contains("gender"), "gender").when(kind.contains("overall"), "incidence")
    told = _last(below.select("row", "block", kinds.alias("kind"), "prevalence_value").where("kind is not null"), ["block", "kind"])
    attributes = told.groupBy("block").pivot("kind", ["age", "gender", "incidence"]).agg(F.first("prevalence_value"))
    heads = named.where(head).select(F.col("row").alias("block"), "condition")
    symptoms = below.where(F.col("symptom").isNotNull()).select(
        "row", "block", symptom_key(F.col("symptom")).alias("slug"), *[F.coalesce(c, F.lit(NOT_GIVEN)).alias(c) for c in ("probability", *ATTRIBUTE_CELLS)]
    )
    return heads.join(attributes, "block", "left"), _last(symptoms, ["block", "slug"]).drop("row")


def _last(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last row of each key; row numbers are unique."""
    return rows.join(rows.groupBy(*keys).agg(F.max("row").alias("row")).select("row"), "row", "left_semi")


def _shares(cell: str) -> Column:
    return F.when(F.lower(cell) != NOT_GIVEN, named_percentages(F.lower(cell)))


def clean_blocks(blocks: DataFrame, symptoms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conditions (condition, block, age, male, female, incidence), their definitions and the rejected blocks.

    Definitions: (condition, slug, share, nature, location, intensity, duration, excitation): nature and location as maps from
    name to percent, the others as lower-case text; NULL where the cell is empty. A block with a name or a cell that does not
    fit its grammar is rejected whole, with all its reasons: (block, name, reasons). Of blocks with the same
    name the last stands, as sheets are read in order.
    """
    name = slugify(F.trim(F.regexp_extract("condition", _NAME, 1)))
    named = blocks.withColumn("name", F.when(name != "", name))
    place = F.lower("location")
    parsed = symptoms.select(
        "block",
        "slug",
        percent_max(F.lower("probability")).alias("share"),
        _shares("nature").alias("nature"),
        F.when(place != NOT_GIVEN, locations(place)).alias("location"),
        *[F.when(F.lower(c) != NOT_GIVEN, F.lower(c)).alias(c) for c in ("intensity", "duration", "excitation")],
    )
    wrong = F.array_compact(
        F.array(
            F.when(F.col("share").isNull(), "probability"),
            F.when(F.size("nature") == 0, "nature"),
            F.when((F.size("location") == 0) | F.exists(F.map_keys("location"), lambda k: k == ""), "location"),
        )
    )
    parsed = store(parsed.withColumn("_wrong", wrong), "sheet_cells")
    faults = parsed.select("block", F.explode("_wrong").alias("reason")).unionByName(named.where("name is null").select("block", F.lit("condition").alias("reason")))
    bad = settle(faults.groupBy("block").agg(F.array_sort(F.collect_set("reason")).alias("reasons")))
    rejects = named.join(bad, "block").select("block", F.col("condition").alias("name"), "reasons")
    good = named.join(bad, "block", "left_anti")
    last = good.groupBy("name").agg(F.max("block").alias("block"))
    shares = gender_shares(F.col("gender"))
    conditions = good.join(last.select("block"), "block", "left_semi").select(
        F.col("name").alias("condition"), "block", "age", shares["male"].alias("male"), shares["female"].alias("female"), "incidence"
    )
    conditions = store(conditions, "conditions")
    definitions = parsed.drop("_wrong").join(conditions.select("block", "condition"), "block").drop("block")
    return conditions, definitions.select("condition", "slug", "share", *ATTRIBUTE_CELLS), rejects
