"""Streams of record files: incremental fit, incremental validation, line parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import bayes as N
from ..session import scratch_path
from ..streaming import incremental as I
from . import roles as S
from .models import BEST, feature_set, nb_sql, training
from .registry import Tables, query
from .roles import r6
from .scans import compact

RECORD = "row_id bigint, label string, age int, tokens array<string>"


def record_files(t: Tables) -> str:
    """The records as a folder of files, so that a stream has several batches."""
    path = scratch_path(t.spark, "records")
    rows = training(t, "label").select("row_id", "label", F.col("age").cast("int").alias("age"), "tokens")
    rows.repartition(4, "row_id").write.parquet(path)
    return path


@query("s1_incremental_fit", f"{nb_sql(label='label')} {BEST}")
def s1(t: Tables) -> DataFrame:
    """Batch after batch; the model equals that of one batch."""
    files = record_files(t)
    stream = I.record_stream(t.spark, files, RECORD, 2)
    counts, stats = I.fit_stream(stream, "label", "tokens", ["age"], scratch_path(t.spark, "fit"), scratch_path(t.spark, "stream"))
    model = N.fit_counts(counts, stats, feature_set(t), ["age"])
    scored = model.score(t.spark.read.schema(RECORD).parquet(files), "tokens", 1)
    top = F.get("top", 0)
    return scored.select("row_id", top["label"].alias("pred"), r6(top["p"]).alias("p"))


@query("s1_stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s1_counts(t: Tables) -> DataFrame:
    source = t.spark.readStream.schema(t.events.schema).parquet(t.path("events") + "*")
    return I.running_counts(source, ["event_type"], scratch_path(t.spark, "counts"), scratch_path(t.spark, "stream"))


@query(
    "s2_incremental_validation",
    f"""{nb_sql(label='label')}, pd AS (SELECT row_id, any_value(label) AS label, max(CASE WHEN rank = 1 THEN cand END) AS pred FROM pr GROUP BY row_id)
SELECT count(*) FILTER (WHERE label = pred) AS correct, count(*) AS total, round(count(*) FILTER (WHERE label = pred) / count(*), 6) AS accuracy FROM pd""",
)
def s2(t: Tables) -> DataFrame:
    files = record_files(t)
    model = N.fit(t.spark.read.schema(RECORD).parquet(files), "label", "tokens", feature_set(t), ["age"])
    out = I.validate_stream(I.record_stream(t.spark, files, RECORD, 2), model, "label", "tokens", scratch_path(t.spark, "valid"), scratch_path(t.spark, "stream"))
    return out.withColumn("accuracy", r6(F.col("accuracy")))


@query(
    "s3_line_stream",
    f"""{S.BASE} SELECT patient::VARCHAR AS patient, CAST(gender = 0 AS INTEGER) AS gender, race, age, label AS condition, array_to_string(codes, ';') AS codes FROM rec""",
)
def s3(t: Tables) -> DataFrame:
    source, out = scratch_path(t.spark, "lines"), scratch_path(t.spark, "parsed")
    compact(t).write.option("header", "true").option("emptyValue", "").csv(source)
    rows = I.parse_stream(t.spark, source, out, scratch_path(t.spark, "stream"), {str(i): i for i in range(5)}, 2)
    return rows.withColumn("codes", F.array_join("codes", ";"))
