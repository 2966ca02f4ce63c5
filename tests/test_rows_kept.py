"""Rows with missing or odd values stay in the result."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from anamnesis.functions import codes, text
from anamnesis.operators import aggregates, evaluation, features, knowledge, ordering, scores
from anamnesis.sources import tables
from anamnesis.streaming import incremental


def test_null_order_values(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0), (4, 3.0)], "id int, v double")
    assert {r["id"]: r["rn"] for r in ordering.value_rank(df, [], "v").collect()} == {1: 1, 3: 2, 4: 3, 2: 4}
    assert {r["id"]: r["rn"] for r in ordering.value_rank(df, [], "v", descending=True).collect()} == {2: 1, 4: 2, 3: 3, 1: 4}
    filled = ordering.forward_fill(spark.createDataFrame([(None, "x"), (1.0, None), (2.0, "a"), (3.0, None)], "o double, c string"), "o", ["c"])
    assert filled.count() == 4


def test_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title line of words\nname,count\nx,1\nbad\ny,2\nz,oops\n")
    schema = StructType([StructField("n", StringType()), StructField("c", IntegerType())])
    got = tables.read_below_lines(spark, str(tmp_path / "a.csv"), schema).collect()
    assert len(got) == 4 and {r["n"] for r in got} == {"x", "bad", "y", "z"}
    (tmp_path / "b.csv").write_text("n,c\n,1\nu,2\n")
    assert tables.read_chunks(spark, str(tmp_path / "b.csv"), schema, "n").count() == 2


def test_lines(spark):
    lines = ["PATIENT,GENDER,RACE,ETHNICITY,AGE_BEGIN,AGE_END,PATHOLOGY,NUM_SYMPTOMS,SYMPTOMS", "p1,F,white,,44,45,c,2,a;b", "p2,M,,,,45,c,1,a", '"p,3",F,black,"x, y",7,8,c,1,b']
    got = incremental.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["patient"], r["age"]) for r in got] == [("p1", 44), ("p2", None), ("p,3", 7)]


def test_unknown_race(spark):
    rows = spark.createDataFrame([(1, 0, None, 30, ["a"]), (2, 1, 4, 5, ["b"])], "row_id int, gender int, race int, age int, codes array<string>")
    assert features.sparse_rows(rows, ["a", "b"]).count() == 2
    got = {r["row_id"]: r["features"].toArray().tolist() for r in features.one_hot_rows(rows, ["a", "b"], False).collect()}
    assert got == {1: [30, 0, 0, 0, 0, 0, 0, 1, 0], 2: [5, 1, 0, 0, 0, 0, 1, 0, 1]}


def test_no_division_by_zero(spark):
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "label string, x double")
    assert [r["x_norm"] for r in scores.normalised(same, ["x"]).collect()] == [None, None]
    assert [r["band"] for r in aggregates.size_bands(same, "label").collect()] == [None, None]
    top = "array<struct<label:string,p:double>>"
    scored = spark.createDataFrame([("a", [("a", 0.7), ("b", 0.3)]), ("a", [("a", 0.4), ("b", 0.6)])], f"label string, top {top}")
    assert {r["cand"]: r["auc"] for r in evaluation.auc_one_vs_rest(scored, "label").collect()} == {"a": None, "b": None}


def test_masks_do_not_wrap(spark):
    df = spark.createDataFrame([([1, 1, 61],)], "i array<int>")
    assert df.select(codes.bit_mask(F.col("i"))).first()[0] == (1 << 61) + 2
    with pytest.raises(Exception, match="a mask has 62 bits"):
        spark.createDataFrame([([64],)], "i array<int>").select(codes.bit_mask(F.col("i"))).collect()


def test_ranges_of_cells(spark):
    df = spark.createDataFrame([("chest (10-20%) back (3,5%)", "10 - 20 %")], "c string, p string")
    got = df.select(text.named_percentages(F.col("c")).alias("n"), text.percent_max(F.col("p")).alias("m"), text.locations(F.col("c")).alias("l")).first()
    assert got["n"] == {"chest": 20.0, "back": 3.5} and got["m"] == 20.0 and got["l"] == {"chest": 20.0, "back": 3.5}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "a int, b int")
    assert knowledge.reachable(edges, edges.where("a = 0"), "a", "b", "a").count() == 71
