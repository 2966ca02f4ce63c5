"""Scans: record files, dictionaries, definition sheets, run logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt"


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str | None = None,
    header: bool = True,
    columns: Sequence[str] | None = None,
    **options: str,
) -> DataFrame:
    """CSV files (path, glob, directory or list; ``.gz`` is unpacked by suffix).

    A given schema pins names and types; without one they are inferred, which costs a pass.
    ``columns`` cuts the scan to a subset.
    """
    reader = spark.read.option("header", str(header).lower())
    for key, value in options.items():
        reader = reader.option(key, value)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    df = reader.csv(list(path) if not isinstance(path, str) else path)
    return df.select(*columns) if columns else df


def read_chunks(spark: SparkSession, path: str, schema: StructType, mark: str) -> DataFrame:
    """Chunks of one file of which only the first has the header line: that line is dropped by its first cell."""
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    raw = read_csv(spark, path, text, header=False).where(~F.col(schema.fields[0].name).eqNullSafe(mark))
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_below_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV whose files start with lines of free text.

    Lines that do not fit the schema go up to the first line of a file that does; bad lines after it
    stay in the result, with their text in ``_corrupt``. The leading lines lie in the first block.
    """
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    raw = spark.read.schema(wide).option("header", "false").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    tagged = raw.select("*", F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    # Numbers rise along a block; one row a file. All cells are asked for: a cell that is not read cannot be bad.
    firsts = tagged.where(F.col(CORRUPT).isNull() & (F.col("_start") == 0)).groupBy(F.col("_file").alias("_of")).agg(F.min(F.struct("_line", *[f.name for f in schema.fields]))["_line"].alias("_first"))
    placed = tagged.join(firsts, F.col("_file") == F.col("_of"), "left")
    leading = F.col(CORRUPT).isNotNull() & (F.col("_start") == 0) & (F.col("_first").isNull() | (F.col("_line") < F.col("_first")))
    return placed.where(~leading).drop("_start", "_file", "_line", "_of", "_first")


def read_code_map(spark: SparkSession, path: str, key: str = "code", value: str = "name") -> DataFrame:
    """A JSON object code -> name as a dictionary table."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def read_column_json(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """``{"column": {"row": value}}`` documents, one per line: (row, columns...)."""
    schema = "map<string,map<string,string>>"
    doc = spark.read.text(path).select(F.from_json("value", schema).alias("d"))
    cells = doc.select("d", F.explode(F.map_keys(F.element_at("d", list(columns)[0]))).alias("row"))
    picks = [F.try_element_at(F.try_element_at("d", F.lit(c)), F.col("row")).cast(kind).alias(c) for c, kind in columns.items()]
    return cells.select(F.col("row").cast("bigint").alias("row"), *picks)


def read_column_lists(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """``{"column": [values]}`` documents, one per line, as rows."""
    schema = ", ".join(f"`{c}` array<{kind}>" for c, kind in columns.items())
    doc = spark.read.text(path).select(F.from_json("value", schema).alias("d")).select("d.*")
    return doc.select(F.explode(F.arrays_zip(*columns)).alias("r")).select("r.*")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of result JSON documents with the file each came from."""
    return spark.read.schema(schema).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_outline(spark: SparkSession, path: str) -> DataFrame:
    """``s-`` lines are parents of the lines below them: (main, part).

    Files may be of any length: each is read in blocks by many tasks. Lines are in order within their block, and a block
    begins with the last parent of the blocks before it. Blank lines, and lines above the first parent of a file, are left out.
    """
    value, at = F.trim("value"), F.monotonically_increasing_id()
    mark = F.when(F.col("value").startswith("s-"), F.trim(F.expr("substr(value, 3)")))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    # Only the order of the numbers within a block counts, and a block is read by one task from its begin.
    lines = spark.read.text(path).select(*place, value.alias("part"), mark.alias("main"), at.alias("_at")).where("part <> ''")
    last = lines.groupBy("file", "block").agg(F.max(F.when(F.col("main").isNotNull(), F.struct("_at", "main"))).alias("_l"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row a block.
    carried = last.select("file", "block", F.last("_l.main", ignorenulls=True).over(earlier).alias("_before"))
    upto = Window.partitionBy("file", "block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.join(carried, ["file", "block"])
    named = held.withColumn("_main", F.coalesce(F.last("main", ignorenulls=True).over(upto), "_before"))
    return named.where(F.col("main").isNull() & F.col("_main").isNotNull()).select(F.col("_main").alias("main"), "part")


def read_named_sets(spark: SparkSession, driver_file: str, schema: StructType | str) -> DataFrame:
    """A JSON object name -> CSV path: all sets in one table with their name in ``dataset``.

    The driver file is a short configuration; the sets themselves are only scanned.
    """
    entries = read_code_map(spark, driver_file, "dataset", "path").collect()
    frames = [read_csv(spark, r["path"], schema).withColumn("dataset", F.lit(r["dataset"])) for r in entries]
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def with_file_stem(df: DataFrame, out: str = "dataset") -> DataFrame:
    """Name of the folder each row was read from."""
    return df.withColumn(out, F.element_at(F.split(F.input_file_name(), "/"), -2))


def parsed_times(df: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    """Text columns parsed as timestamps; what does not parse is NULL."""
    for name, pattern in formats.items():
        df = df.withColumn(name, F.try_to_timestamp(F.col(name), F.lit(pattern)))
    return df


def pending_labels(labels: DataFrame, done: DataFrame, label: str) -> DataFrame:
    """Labels that have no output yet."""
    return labels.select(label).distinct().join(done.select(label).distinct(), label, "left_anti")


def typed(df: DataFrame, kinds: Mapping[str, str]) -> list[Column]:
    return [F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]
