"""Incremental model statistics and scores over streams of record files.

The tables that the batches of a stream add up to are kept by ``BatchLog``: a batch that is retried after a
failure, and a stream that is started again, count every record once, and the number of folders is bounded.
Every run names the checkpoint folder of its stream; with the same one it goes on where the last run ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.codes import RACE_CODES, race_code
from ..functions.text import code_list
from ..operators import bayes as N
from ..operators.evaluation import predicted
from ..operators.sizes import settle


def record_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000, kind: str = "parquet") -> DataFrame:
    """A folder of record files as a stream; ``files_per_batch`` bounds what one batch reads."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


#: Above every batch number.
_NO_BATCH = 1 << 62


class BatchLog:
    """A keyed table summed over the batches of a stream, kept under ``path``.

    Every batch writes its own small table to one of ``every`` folders, in turn, with its number. After ``every`` batches
    they are summed with the last base into the other one of two base folders. A batch that comes again replaces what
    it wrote, and a sum that is made again starts from the base before it, so nothing is counted twice wherever a
    run was cut off.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], every: int = 16) -> None:
        """``merge`` sums rows of ``schema`` by key, and gives the same whether rows were summed in parts before."""
        self.spark, self.path, self.schema, self.merge, self.every = spark, path.rstrip("/"), schema, merge, every

    def _read(self, kind: str) -> DataFrame:
        schema = f"{self.schema}, _batch bigint, slot int"
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, table: DataFrame, kind: str, slot: int, batch: int) -> None:
        kept = table.withColumn("_batch", F.lit(batch).cast("bigint"))
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{kind}/slot={slot}")

    def _base(self, below: int) -> tuple[DataFrame, int, int]:
        """The last base made of batches under ``below``, its last batch (-1: none) and its folder."""
        bases = self._read("base")
        made = {r["slot"]: r["b"] for r in bases.groupBy("slot").agg(F.max("_batch").alias("b")).collect() if r["b"] < below}
        slot = max(made, key=made.get) if made else 1
        last = made.get(slot, -1)
        return bases.where((F.col("slot") == slot) & (F.col("_batch") == last)), last, slot

    def _sum(self, base: DataFrame, last: int, upto: int) -> DataFrame:
        recent = self._read("recent").where((F.col("_batch") > last) & (F.col("_batch") <= upto))
        return self.merge(base.unionByName(recent).drop("_batch", "slot"))

    def add(self, table: DataFrame, number: int) -> None:
        """What batch ``number`` adds; the batches before it have been added."""
        self._write(table, "recent", number % self.every, number)
        if (number + 1) % self.every == 0:
            # A base of this very batch, from a run that was cut off, is passed over and replaced.
            base, last, slot = self._base(number)
            self._write(settle(self._sum(base, last, number)), "base", 1 - slot, number)

    def total(self) -> DataFrame:
        base, last, _ = self._base(_NO_BATCH)
        return self._sum(base, last, _NO_BATCH)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run ``each`` on every micro-batch of what is there now, then stop; ``checkpoint`` remembers which files were read."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


MODEL_SUMS = "label string, token string, feature string, hits bigint, n bigint, mean double, m2 double"


def _summed_statistics(rows: DataFrame) -> DataFrame:
    """Counts and moments of disjoint row sets in one table: moments where ``feature`` is named."""
    counts, stats = N.merge_counts([rows.where("feature is null")]), N.merge_moments([rows.where("feature is not null")])
    return _one_table(counts, stats)


def _one_table(counts: DataFrame, stats: DataFrame | None) -> DataFrame:
    one = counts.selectExpr("label", "token", "cast(null as string) feature", "hits", "cast(null as bigint) n", "cast(null as double) mean", "cast(null as double) m2")
    if stats is None:
        return one
    return one.unionByName(stats.selectExpr("label", "cast(null as string) token", "feature", "cast(null as bigint) hits", "n", "mean", "m2"))


def fit_stream(
    stream: DataFrame, label: str, tokens: str, numbers: Sequence[str], path: str, checkpoint: str, every: int = 16
) -> tuple[DataFrame, DataFrame]:
    """Count and moment tables of all records of a stream so far, kept under ``path``."""
    log = BatchLog(stream.sparkSession, path, MODEL_SUMS, _summed_statistics, every)
    run_batches(stream, lambda batch, number: log.add(_one_table(*N.statistics(batch, label, tokens, numbers)), number), checkpoint)
    whole = settle(log.total())
    return whole.where("feature is null").select("label", "token", "hits"), whole.where("feature is not null").select("label", "feature", "n", "mean", "m2")


def validate_stream(stream: DataFrame, model: N.BayesModel, label: str, tokens: str, path: str, checkpoint: str, every: int = 16) -> DataFrame:
    """(correct, total, accuracy) of a model over all records of a stream so far."""

    def summed(rows: DataFrame) -> DataFrame:
        return rows.agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))

    log = BatchLog(stream.sparkSession, path, "correct bigint, total bigint", summed, every)

    def each(batch: DataFrame, number: int) -> None:
        scored = model.score(batch, tokens, 1)
        log.add(scored.agg(F.count_if(predicted() == F.col(label)).alias("correct"), F.count(F.lit(1)).alias("total")), number)

    run_batches(stream, each, checkpoint)
    return log.total().withColumn("accuracy", F.col("correct") / F.col("total"))


def running_counts(stream: DataFrame, keys: Sequence[str | Column], path: str, checkpoint: str) -> DataFrame:
    """Counts per key in the state store; the last complete result is kept under ``path``, in one of two folders in turn.

    Meant for keys of a bounded dictionary, as the state holds one row per key.
    """
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/slot={number % 2}")

    query = counts.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = stream.sparkSession.read.parquet(path)
    last = kept.agg(F.max("_batch")).scalar()
    return kept.where(F.col("_batch") == last).drop("_batch", "slot")


# Cell positions of a line of the compact record file.
LINE_CELLS = {"GENDER": 1, "RACE": 2, "AGE": 4, "CONDITION": 6, "SYMPTOMS": 8}


HEADER_CELL = "PATIENT"


def parse_lines(lines: DataFrame, races: dict[str, int] | None = None) -> DataFrame:
    """Text lines of the compact file as (gender, race, age, condition, codes); only the header line drops out.

    Cells may be quoted. A missing or bad age is NULL.

    Here M is 0 and everything else 1.
    """
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(max(LINE_CELLS.values()) + 1)))
    part = {name: cells[f"c{i}"] for name, i in LINE_CELLS.items()}
    age = part["AGE"].try_cast("int")
    return lines.where(~cells["c0"].eqNullSafe(HEADER_CELL)).select(
        cells["c0"].alias("patient"),
        F.when(part["GENDER"] == "M", 0).otherwise(1).alias("gender"),
        race_code(part["RACE"], races or RACE_CODES).alias("race"),
        age.alias("age"),
        part["CONDITION"].alias("condition"),
        code_list(part["SYMPTOMS"]).alias("codes"),
    )


def parse_stream(spark: SparkSession, source: str, path: str, checkpoint: str, races: dict[str, int] | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Parse a stream of record lines into a table of records under ``path``; started again, only files not read before."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(source)
    out = parse_lines(lines, races).writeStream.format("parquet").option("path", path)
    query = out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)
