"""Column functions for slugs, keys and the free-text cells of the definition sheets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Cells of the definition sheets: numbers with decimal comma or point, ranges, and an optional percent sign.
NUMBER = r"(\d+(?:[.,]\d+)?)"
PERCENT_CELL = rf"^{NUMBER}%?(?:-{NUMBER}%?)?"
NAMED_CELL = rf"([\w\s]+)\({NUMBER}%?(?:-{NUMBER}%?)?\)"
ATTRIBUTE_NAME_PATTERN = r"^(.*)-nlice-(.*)-(.*)$"
ATTRIBUTE_MARK = "nlice"
PAIR_PATTERN = r"(\d+)\|(\d+)"
MALE_AFTER = r"(?i)\bmales?\s*[:(]?\s*([0-9]+(?:[.,][0-9]+)?)\s*%"
MALE_BEFORE = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*%\s*males?\b"
FEMALE_AFTER = r"(?i)\bfemales?\s*[:(]?\s*([0-9]+(?:[.,][0-9]+)?)\s*%"
FEMALE_BEFORE = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*%\s*females?\b"


def slugify(name: Column) -> Column:
    """Lower case; runs of blanks and quotes become ``-``; parentheses go."""
    out = F.regexp_replace(F.lower(name), r"\s+", "-")
    out = F.regexp_replace(out, "'", "-")
    return F.regexp_replace(out, r"[()]", "")


def symptom_key(name: Column) -> Column:
    """Lower case, trimmed, runs of blanks as ``_``."""
    return F.regexp_replace(F.trim(F.lower(name)), r"\s+", "_")


def hash_key(name: Column) -> Column:
    """SHA-224 hex surrogate key (56 characters)."""
    return F.sha2(name, 224)


def url_slug(url: Column, prefix_pattern: str) -> Column:
    """What follows ``prefix_pattern`` at the start of a URL; NULL where it does not match."""
    return F.when(url.rlike("^" + prefix_pattern), F.regexp_extract(url, "^" + prefix_pattern + "(.*)$", 1))


def likelihood(text: Column) -> Column:
    """``"1.3x"`` as 1.3; NULL where it is no number."""
    return F.split_part(F.trim(text), F.lit("x"), F.lit(1)).try_cast("double")


def percent_max(cell: Column) -> Column:
    """Upper end of ``10%``, ``8,5%`` or ``10-20%``; ``n/a`` is 0, anything else NULL."""
    text = F.regexp_replace(cell, r"\s+", "")
    low, high = (_number(F.regexp_extract(text, PERCENT_CELL, i)) for i in (1, 2))
    return F.when(cell == "n/a", F.lit(0.0)).otherwise(F.greatest(low, high))


def named_percentages(cell: Column) -> Column:
    """All ``name (12,5%)`` pairs of a cell as a map from slug to number; of a range the upper end."""
    low = F.regexp_extract_all(cell, F.lit(NAMED_CELL), F.lit(2))
    high = F.regexp_extract_all(cell, F.lit(NAMED_CELL), F.lit(3))
    names = F.transform(
        F.regexp_extract_all(cell, F.lit(NAMED_CELL), F.lit(1)), lambda n: symptom_key(n)
    )
    entries = F.zip_with(names, F.zip_with(low, high, lambda a, b: F.coalesce(_number(b), _number(a))), lambda n, v: F.struct(n.alias("k"), v.alias("v")))
    # A name given twice keeps its last value.
    keys = F.array_distinct(names)
    last = F.zip_with(
        keys, F.array_repeat(entries, F.size(keys)), lambda k, es: F.element_at(F.filter(es, lambda e: e["k"] == k), -1)["v"]
    )
    return F.map_from_arrays(keys, last)


def locations(cell: Column) -> Column:
    """Location shares of a cell; one bare name counts 100."""
    bare = symptom_key(F.regexp_extract(cell, r"^([\w\s]+)", 1))
    shares = named_percentages(F.regexp_replace(F.regexp_replace(cell, r"\s+", ""), "[:;]", ""))
    return F.when(~cell.contains("%"), F.create_map(bare, F.lit(100.0))).otherwise(shares)


def _number(text: Column) -> Column:
    return F.when(text == "", None).otherwise(F.regexp_replace(text, ",", ".").try_cast("double"))


def gender_shares(cell: Column) -> Column:
    """Struct (male, female) of the percentages given before or after each word."""

    def share(after: str, before: str) -> Column:
        return F.coalesce(_number(F.regexp_extract(cell, after, 1)), _number(F.regexp_extract(cell, before, 1)))

    return F.struct(share(MALE_AFTER, MALE_BEFORE).alias("male"), share(FEMALE_AFTER, FEMALE_BEFORE).alias("female"))


def attribute_parts(name: Column) -> Column:
    """Split ``base-nlice-attribute-value``; a plain name is its own symptom."""
    part = [F.regexp_extract(name, ATTRIBUTE_NAME_PATTERN, i) for i in (1, 2, 3)]
    coded = name.rlike(ATTRIBUTE_NAME_PATTERN)
    return F.struct(
        F.when(coded, part[0]).otherwise(name).alias("symptom"),
        F.when(coded, part[1]).alias("attribute"),
        F.when(coded, part[2]).alias("value"),
    )


def first_pair(cell: Column) -> Column:
    """First ``index|value`` item of a cell as struct (index, value), NULLs where there is none."""
    return F.struct(
        F.regexp_extract(cell, PAIR_PATTERN, 1).try_cast("int").alias("index"),
        F.regexp_extract(cell, PAIR_PATTERN, 2).try_cast("int").alias("value"),
    )


def run_parameter(run_name: Column, parameter: str) -> Column:
    """Value of ``parameter_value`` in a run name; ``None`` and absence are NULL."""
    value = F.regexp_extract(run_name, parameter + "_([0-9A-Za-z]+)", 1)
    return F.when(~value.isin("", "None"), value)


def initials(name: Column) -> Column:
    """First two letters of a one-word name, first letters pairs of a longer one, in Title case."""
    words = F.filter(F.split(name, " "), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1)))), ""
    )


def is_yes_no(answers: Column, yes: str = "ja", no: str = "nee") -> Column:
    """Whether the two possible answers are yes and no."""
    clean = F.transform(answers, lambda a: F.trim(F.lower(a)))
    return (F.size(answers) == 2) & F.array_contains(clean, yes) & F.array_contains(clean, no)


def code_list(text: Column) -> Column:
    """``a;b;c`` as an array; an empty or NULL cell is an empty array."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ";"))


def index_list(text: Column, offset: int = 0) -> Column:
    """``3,17`` as an int array, each moved by ``offset``."""
    return F.transform(F.split(text, ","), lambda v: v.cast("int") + F.lit(offset))


def encode_list(codes: Column, mapping: Column) -> Column:
    """Codes to numbers by a map column, joined with ``,``; unknown codes drop out."""
    found = F.filter(F.transform(codes, lambda c: F.try_element_at(mapping, c)), lambda v: v.isNotNull())
    return F.array_join(F.transform(found, lambda v: v.cast("string")), ",")
