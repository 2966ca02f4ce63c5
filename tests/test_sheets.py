"""Definition sheets: blocks by position, layouts, grammars, rejected blocks."""

import pytest

from anamnesis.operators import sheets as H

SCHEMA = "layout string, sheet string, row long, cells array<string>"
SWAPPED = (*H.ROLES[:6], "intensity", "location", *H.ROLES[8:])
LAYOUTS = {"usual": H.ROLES, "swapped": SWAPPED}


def cells(layout=H.ROLES, **given):
    return [given.get(role) for role in layout]


def read(spark, rows):
    return H.sheet_blocks(spark.createDataFrame(rows, SCHEMA), LAYOUTS)


@pytest.fixture(scope="module")
def rows():
    data = [
        ("usual", "s1", cells(symptom="lost", probability="5%")),  # before any header
        ("usual", "s1", cells(condition=" Flu (new) ", symptom="not read")),
        ("usual", "s1", [None, " ", ""]),
        ("usual", "s1", cells(prevalence="Age of onset", prevalence_value="20-30", symptom="High  Fever", probability="80 - 90%", nature="Dry (10%), wet(12,5%)")),
        ("usual", "s1", cells(prevalence="GENDER", prevalence_value="males: 8.6%, females 17.5%", symptom="cough", probability="n/a", location="Chest")),
        ("usual", "s1", cells(symptom="high fever", probability="7,5%", location="left arm (20%): head (1-4%)", duration="2 Days")),
        ("usual", "s1", cells(condition="Cold")),
        ("usual", "s1", cells(symptom="cough", probability="often", nature="dry")),
        ("swapped", "s2", cells(SWAPPED, symptom="headless", probability="1%")),
        ("swapped", "s2", cells(SWAPPED, condition="flu")),
        ("swapped", "s2", cells(SWAPPED, prevalence="overall", prevalence_value="rare")),
        ("swapped", "s2", cells(SWAPPED, condition="Flu")),
        ("swapped", "s2", cells(SWAPPED, symptom="Ache", probability="30%", location="back", intensity="Strong", excitation="Eating")),
        ("swapped", "s2", cells(SWAPPED, condition="(?)")),
        ("usual", "s3", cells(condition="Empty one")),
        ("unknown", "s4", ["x"] * 10),
    ]
    return [(layout, sheet, i, c) for i, (layout, sheet, c) in enumerate(data)]


def test_blocks(spark, rows):
    blocks, symptoms = read(spark, rows)
    assert {r["block"]: (r["condition"], r["age"], r["gender"], r["incidence"]) for r in blocks.collect()} == {
        1: ("Flu (new)", "20-30", "males: 8.6%, females 17.5%", None), 6: ("Cold", None, None, None), 9: ("flu", None, None, "rare"), 11: ("Flu", None, None, None),
        13: ("(?)", None, None, None), 14: ("Empty one", None, None, None),
    }
    got = {(r["block"], r["slug"]): (r["probability"], r["nature"], r["location"], r["intensity"], r["duration"], r["excitation"]) for r in symptoms.collect()}
    none = H.NOT_GIVEN
    assert got == {
        (1, "high_fever"): ("7,5%", none, "left arm (20%): head (1-4%)", none, "2 Days", none),
        (1, "cough"): ("n/a", none, "Chest", none, none, none),
        (6, "cough"): ("often", "dry", none, none, none, none),
        (11, "ache"): ("30%", none, "back", "Strong", none, "Eating"),
    }


def test_clean(spark, rows):
    conditions, definitions, rejects = H.clean_blocks(*read(spark, rows))
    # "Flu (new)" is cut to its name; the last of the three stands.
    assert {r["condition"]: r["block"] for r in conditions.collect()} == {"flu": 11, "empty-one": 14}
    assert {(r["condition"], r["slug"]): (r["share"], r["nature"], r["location"], r["intensity"], r["duration"], r["excitation"]) for r in definitions.collect()} == {
        ("flu", "ache"): (30.0, None, {"back": 100.0}, "strong", None, "eating")
    }
    assert {r["block"]: (r["name"], r["reasons"]) for r in rejects.collect()} == {6: ("Cold", ["nature", "probability"]), 13: ("(?)", ["condition"])}


def test_maps(spark, rows):
    """Without the later blocks of the name: ranges, commas, several parts, gender shares."""
    conditions, definitions, _ = H.clean_blocks(*read(spark, rows[:8]))
    assert [(r["condition"], r["age"], r["male"], r["female"]) for r in conditions.collect()] == [("flu", "20-30", 8.6, 17.5)]
    got = {r["slug"]: (r["share"], r["nature"], r["location"], r["duration"]) for r in definitions.collect()}
    assert got == {"high_fever": (7.5, None, {"leftarm": 20.0, "head": 4.0}, "2 days"), "cough": (0.0, None, {"chest": 100.0}, None)}
    nature = H.clean_blocks(*read(spark, rows[:5]))[1].where("slug = 'high_fever'").first()
    assert (nature["share"], nature["nature"]) == (90.0, {"dry": 10.0, "wet": 12.5})


def test_no_rows(spark):
    blocks, symptoms = read(spark, [("usual", "s", 1, cells())])
    assert blocks.count() == symptoms.count() == 0
    assert [t.count() for t in H.clean_blocks(blocks, symptoms)] == [0, 0, 0]
