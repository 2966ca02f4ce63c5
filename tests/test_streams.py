"""Streams: started again, cut off, with more files, and what they leave behind."""

import os

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import bayes as N
from anamnesis.streaming import incremental as I

RECORD = "row_id bigint, label string, age int, tokens array<string>"
WORDS = [f"w{i}" for i in range(6)]


def records(spark, first, last):
    rows = spark.range(first, last).withColumnRenamed("id", "row_id")
    tokens = F.array_compact(F.array(*[F.when(F.col("row_id") % (i + 2) == 0, w) for i, w in enumerate(WORDS)]))
    return rows.select("row_id", F.concat(F.lit("c"), F.col("row_id") % 4).alias("label"), (F.col("row_id") % 61).cast("int").alias("age"), tokens.alias("tokens"))


def add_files(spark, path, first, last, files):
    step = (last - first) // files
    for i in range(files):
        records(spark, first + i * step, last if i == files - 1 else first + (i + 1) * step).coalesce(1).write.mode("append").parquet(path)


def table(counts, stats):
    return (
        sorted(map(repr, map(tuple, counts.select("label", "token", "hits").collect()))),
        sorted((r["label"], r["feature"], r["n"], round(r["mean"], 9), round(r["m2"], 6)) for r in stats.collect()),
    )


def folders(path):
    return sum(d.startswith("slot=") for _, dirs, _ in os.walk(path) for d in dirs)


@pytest.mark.parametrize("every", [1, 3, 16])
def test_restarted_fit_counts_once(spark, tmp_path, every):
    files, state, place = (str(tmp_path / n) for n in ("files", "state", "place"))

    def run():
        return table(*I.fit_stream(I.record_stream(spark, files, RECORD, 1), "label", "tokens", ["age"], state, place, every))

    add_files(spark, files, 0, 400, 4)
    want = table(*N.statistics(records(spark, 0, 400), "label", "tokens", ["age"]))
    assert run() == want
    assert run() == want  # nothing new
    add_files(spark, files, 400, 700, 3)
    assert run() == table(*N.statistics(records(spark, 0, 700), "label", "tokens", ["age"]))
    assert folders(state) <= every + 2


@pytest.mark.parametrize("every", [1, 2, 3])
@pytest.mark.parametrize("at", range(5))
@pytest.mark.parametrize("when", ["before", "after"])
def test_cut_off_batch_counts_once(spark, tmp_path, every, at, when):
    """The log alone: batch ``at`` fails before or after its write, then comes again."""
    def summed(rows):
        return rows.groupBy("key").agg(F.sum("n").alias("n"))

    log = I.BatchLog(spark, str(tmp_path / "log"), "key string, n bigint", summed, every)

    def batch(i):
        return spark.createDataFrame([("a", 1), (f"k{i}", i)], "key string, n bigint")

    for i in range(5):
        if i == at:
            if when == "before":
                spark.createDataFrame([("a", 99)], "key string, n bigint").withColumn("_batch", F.lit(i).cast("bigint")).write.mode("overwrite").parquet(f"{tmp_path}/log/recent/slot={i % every}")
            else:
                log.add(batch(i), i)
        log.add(batch(i), i)
    assert {r["key"]: r["n"] for r in log.total().collect()} == {"a": 5, **{f"k{i}": i for i in range(5)}}


def test_killed_stream_goes_on(spark, tmp_path):
    """A batch that fails after its sums were written: the next run counts it once."""
    files, state, place = (str(tmp_path / n) for n in ("files", "state", "place"))
    add_files(spark, files, 0, 300, 3)
    add = I.BatchLog.add

    def failing(self, rows, number):
        add(self, rows, number)
        if number == 1:
            raise RuntimeError("cut off")

    I.BatchLog.add = failing
    try:
        with pytest.raises(Exception, match="cut off"):
            I.fit_stream(I.record_stream(spark, files, RECORD, 1), "label", "tokens", ["age"], state, place, 2)
    finally:
        I.BatchLog.add = add
    got = table(*I.fit_stream(I.record_stream(spark, files, RECORD, 1), "label", "tokens", ["age"], state, place, 2))
    assert got == table(*N.statistics(records(spark, 0, 300), "label", "tokens", ["age"]))


def test_restarted_validation_and_counts(spark, tmp_path):
    files = str(tmp_path / "files")
    add_files(spark, files, 0, 200, 2)
    words = spark.createDataFrame([(w,) for w in WORDS], "token string")
    model = N.fit(records(spark, 0, 200), "label", "tokens", words, ["age"])

    def validate():
        return tuple(I.validate_stream(I.record_stream(spark, files, RECORD, 1), model, "label", "tokens", str(tmp_path / "v"), str(tmp_path / "vc"), 2).first())

    def count():
        return {r["label"]: r["n"] for r in I.running_counts(I.record_stream(spark, files, RECORD, 1), ["label"], str(tmp_path / "c"), str(tmp_path / "cc")).collect()}

    first = validate()
    assert first[1] == 200 and validate() == first and count() == {f"c{i}": 50 for i in range(4)} == count()
    add_files(spark, files, 200, 300, 1)
    assert validate()[1] == 300 and count() == {f"c{i}": 75 for i in range(4)}
    assert folders(str(tmp_path / "c")) <= 2


def test_restarted_lines_are_kept_once(spark, tmp_path):
    source, out, place = (str(tmp_path / n) for n in ("lines", "out", "place"))
    line = "p{0},M,white,x,{0},x,cond,2,a;b"
    spark.createDataFrame([(line.format(i),) for i in range(5)], "value string").coalesce(1).write.text(source)
    assert I.parse_stream(spark, source, out, place).count() == 5
    assert I.parse_stream(spark, source, out, place).count() == 5
    spark.createDataFrame([(line.format(i),) for i in range(5, 8)], "value string").coalesce(1).write.mode("append").text(source)
    assert {r["age"] for r in I.parse_stream(spark, source, out, place).collect()} == set(range(8))


def test_unbounded_state_without_checkpoint_is_refused(spark, tmp_path):
    with pytest.raises(TypeError):
        I.fit_stream(I.record_stream(spark, str(tmp_path), RECORD), "label", "tokens", ["age"], str(tmp_path))
