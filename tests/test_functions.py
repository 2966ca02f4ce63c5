"""Column functions on the samples of the definition sheets."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.functions import codes as C
from anamnesis.functions import maths as M
from anamnesis.functions import text as X
from anamnesis.operators import features as L
from anamnesis.operators import knowledge as J


def one(spark, column, **cells):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]) if cells else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("cell, male, female", [
    ("(16% male, 84% female)", 16.0, 84.0),
    ("male (42%), female (42%)", 42.0, 42.0),
    ("male (85,7%), female (14,3%)", 85.7, 14.3),
    ("males: 8.6%, females 17.5%", 8.6, 17.5),
    ("35% male, 65% female", 35.0, 65.0),
])
def test_gender_shares(spark, cell, male, female):
    got = one(spark, X.gender_shares(F.lit(cell)))
    assert (got.male, got.female) == (male, female)


@pytest.mark.parametrize("cell, share", [("10%", 10.0), ("8,5%", 8.5), ("10-20%", 20.0), ("12.5 - 7 %", 12.5), ("n/a", 0.0), ("often", None)])
def test_percent_max(spark, cell, share):
    assert one(spark, X.percent_max(F.lit(cell))) == share


def test_named_percentages(spark):
    got = one(spark, X.named_percentages(F.lit("aching (12%) dull pain (3,5%) aching (7%)")))
    assert got == {"aching": 7.0, "dull_pain": 3.5}


def test_locations(spark):
    assert one(spark, X.locations(F.lit("lower back"))) == {"lower_back": 100.0}


def test_hash_and_slug(spark):
    assert one(spark, X.hash_key(F.lit("headache"))) == hashlib.sha224(b"headache").hexdigest()
    assert one(spark, X.slugify(F.lit("Crohn's  Disease (acute)"))) == "crohn-s-disease-acute"


def test_attribute_parts(spark):
    got = one(spark, X.attribute_parts(F.lit("abdominal-pain-nlice-location-ruq")))
    assert tuple(got) == ("abdominal-pain", "location", "ruq")
    assert tuple(one(spark, X.attribute_parts(F.lit("cough")))) == ("cough", None, None)


def test_likelihood_and_run_parameter(spark):
    assert one(spark, X.likelihood(F.lit("1.3x"))) == 1.3
    assert one(spark, X.likelihood(F.lit("n/a"))) is None
    assert one(spark, X.run_parameter(F.lit("rf depth_None leaf_2"), "depth")) is None
    assert one(spark, X.run_parameter(F.lit("rf depth_None leaf_2"), "leaf")) == "2"


def test_bit_functions(spark):
    indices = F.array(*[F.lit(i) for i in (3, 0, 3)])
    assert one(spark, C.bit_mask(indices)) == 9
    assert one(spark, C.has_bit(C.bit_mask(indices), 3)) == 1
    assert one(spark, C.multi_hot(indices, 5)) == [1, 0, 0, 1, 0]
    assert one(spark, C.bits_to_number(C.multi_hot(indices, 4))) == 9


def test_ages(spark):
    birth, onset = F.lit("1990-06-01").cast("date"), F.lit("2020-03-01").cast("date")
    assert one(spark, C.age(birth, onset)) == 30
    assert one(spark, C.age(birth, onset, "years")) == 29
    assert one(spark, C.age(onset, birth, "years")) == 29
    assert one(spark, C.age(onset, birth, "months_int")) == -29


def test_codes_of_missing_values(spark):
    none = F.lit(None).cast("string")
    assert one(spark, C.gender_code(none)) == 1
    assert one(spark, C.gender_code(none, 2)) == 2
    assert one(spark, C.race_code(F.lit("unknown"))) is None
    assert one(spark, C.one_hot_race(F.lit(0))) == [0, 0, 0, 0, 1]


def test_softmax(spark):
    x = [0.3, -2.0, 5.5, 700.0]
    got = one(spark, M.softmax(F.array(*[F.lit(v) for v in x])))
    e = np.exp(np.array(x) - 700)
    assert np.allclose(got, e / e.sum())


def test_attribute_record_example(spark):
    """Two reports, one with a value that is replaced; the code counts the product with the last attribute fastest."""
    values = spark.createDataFrame(
        [("headache", "nature", ["0-None", "aching", "stabbing"]), ("headache", "vas", ["0-None", "mild"]),
         ("headache", "duration", ["0-None", "long", "short"]), ("headache", "location", ["0-None"])],
        "symptom string, attribute string, values array<string>",
    )
    rows = spark.createDataFrame([(1, "headache", "nature", "throbbing", 1.0), (1, "headache", "duration", "short", 2.0)],
                                 "id long, symptom string, attribute string, value string, seq double")
    reductions = spark.createDataFrame([("headache", "throbbing", "aching")], "symptom string, value string, reduced string")
    coded = J.encode_attributes(rows, values, "id", "seq", reductions)
    combos = {r.combo: r.code for r in J.combination_codes(values).collect()}
    assert coded.first()["code"] == combos["aching;0-None;short;0-None"] == 9
    key = hashlib.sha224(b"headache").hexdigest()
    assert J.sparse_attribute_rows(coded, "id").first()["SYMPTOMS"] == f"{key}|9"
    assert len(combos) == 18 and sorted(combos.values()) == list(range(1, 19))


def test_rule_descriptor_nested(spark):
    kind = "array<struct<condition_type:string,gender:string,race:string,operator:string,quantity:int,conditions:array<struct<condition_type:string,operator:string,quantity:int>>>>"
    rules = [("Gender", "F", None, None, None, None), ("And", None, None, None, None, [("Age", ">=", 1), ("Age", "<", 5)]), ("Attribute", None, None, None, None, None)]
    df = spark.createDataFrame([(rules,)], f"r {kind}")
    assert df.select(J.rule_descriptor(F.col("r"))).first()[0] == "F-null->=1 <5-Attribute"


def test_reachability_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c")], "f string, t string")
    starts = spark.createDataFrame([("a",), ("x",)], "s string")
    got = {(r.start, r.node) for r in J.reachable(edges, starts, "f", "t", "s").collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "c"), ("x", "a"), ("x", "b")}


def test_reachability_reads_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "b")], "f string, t string")
    starts = spark.createDataFrame([("a",), ("d",), ("z",), ("a",)], "s string")
    found = J.reachable(edges.mapInArrow(seen, "f string, t string"), starts, "f", "t", "s")
    assert sorted((r.start, r.node) for r in found.collect()) == sorted([("z", "z"), *(("a", n) for n in "abcde"), *(("d", n) for n in "bcde")])
    assert read.value == 5


def test_nominal_deals_no_rows_by_value(spark, capsys):
    rows = spark.createDataFrame([(i, "N" if i % 9 else None) for i in range(500)] + [(500, "A"), (501, "R")], "id int, v string")
    encoding = rows.where("v <> 'N'").select(F.col("v").alias("value")).distinct().withColumn("code", F.when(F.col("value") == "A", 1).otherwise(2))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = L.nominal(rows, "v", encoding, 9, "code")
        assert {r.id: r.code for r in coded.collect()} == {**{i: 9 for i in range(500)}, 500: 1, 501: 2}
        coded.explain()
        assert "hashpartitioning(v#" not in capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
