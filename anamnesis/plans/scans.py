"""Sources and sinks: every query writes to a fresh folder under the shared one and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..operators import bayes as N
from ..operators import knowledge as J
from ..operators import records as R
from ..operators.splits import head_split
from ..schemas import COMPACT, GRID_RESULT, SPARSE
from ..session import scratch_path
from ..sources import sinks, tables
from . import roles as S
from .models import composite, nb_sql, training
from .registry import Tables, query
from .roles import r6

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def saved_csv(df: DataFrame, header: bool = True) -> str:
    path = scratch_path(df.sparkSession, "csv")
    df.write.option("header", str(header).lower()).csv(path)
    return path


def compact(t: Tables) -> DataFrame:
    """Records in the shape of the compact file."""
    rows = R.compact_rows(S.records(t))
    return rows.select(
        F.col("PATIENT").cast("string").alias("PATIENT"),
        F.when(F.col("gender") == 0, "F").otherwise("M").alias("GENDER"),
        F.col("race").cast("string").alias("RACE"),
        F.lit("none").alias("ETHNICITY"),
        F.col("age").alias("AGE_BEGIN"),
        (F.col("age") + 1).alias("AGE_END"),
        F.col("label").alias("PATHOLOGY"),
        "NUM_SYMPTOMS",
        "SYMPTOMS",
    )


@query("a1_csv_inferred", "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def a1(t: Tables) -> DataFrame:
    return tables.read_csv(t.spark, saved_csv(t.customer))


@query("a2_csv_columns_types", "SELECT c_custkey, c_mktsegment FROM customer")
def a2(t: Tables) -> DataFrame:
    return tables.read_csv(t.spark, saved_csv(t.customer), CUSTOMER, columns=["c_custkey", "c_mktsegment"])


@query("a3_csv_named", "SELECT c_custkey AS id, c_mktsegment AS race FROM customer")
def a3(t: Tables) -> DataFrame:
    path = saved_csv(t.customer, header=False)
    return tables.read_csv(t.spark, path, "id bigint, name string, place int, amount double, race string", header=False, columns=["id", "race"])


@query("a4_first_chunk_header", "SELECT o_orderkey AS row_id, o_orderpriority AS label FROM orders")
def a4(t: Tables) -> DataFrame:
    """Two chunks of one file; only the first has the header."""
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"))
    path = scratch_path(t.spark, "chunks")
    text = rows.select(F.col("row_id").cast("string"), "label")
    head = t.spark.range(1).select(F.lit("row_id").alias("row_id"), F.lit("label").alias("label"))
    head.unionByName(text.where("label < '3'")).write.option("header", "false").csv(f"{path}/chunk-00")
    text.where("label >= '3'").write.option("header", "false").csv(f"{path}/chunk-01")
    return tables.read_chunks(t.spark, f"{path}/chunk-*", StructType.fromDDL("row_id bigint, label string"), "row_id")


@query("a5_csv_dates", "SELECT o_orderkey AS row_id, CAST(o_orderdate AS DATE) AS day FROM orders")
def a5(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm").alias("day"))
    back = tables.read_csv(t.spark, saved_csv(rows), "row_id bigint, day string")
    return tables.parsed_times(back, {"day": "dd/MM/yyyy HH:mm"}).withColumn("day", F.col("day").cast("date"))


@query("a6_glob", "SELECT n_nationkey AS code, n_name AS name FROM nation UNION ALL SELECT c_custkey::INTEGER, c_name FROM customer")
def a6(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "glob")
    t.nation.select("n_nationkey", "n_name").write.csv(f"{path}/part-a")
    t.customer.select("c_custkey", "c_name").write.csv(f"{path}/part-b")
    return tables.read_csv(t.spark, f"{path}/part-*", "code int, name string", header=False)


@query("a7_gzip_scan", "SELECT c_custkey, c_nationkey FROM customer")
def a7(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "gz")
    sinks.write_gzip_csv(t.customer, path)
    return tables.read_csv(t.spark, path, CUSTOMER, columns=["c_custkey", "c_nationkey"])


@query("a8_gzip_sink", "SELECT o_orderkey AS row_id, o_totalprice AS price FROM orders")
def a8(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "gz")
    sinks.write_gzip_csv(t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price")), path)
    return tables.read_csv(t.spark, f"{path}/*.csv.gz", "row_id bigint, price double")


@query("a9_json_dictionary", "SELECT DISTINCT p_brand AS code, min(p_name) AS name FROM part GROUP BY 1")
def a9(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "dictionary")
    names = t.part.groupBy(F.col("p_brand").alias("code")).agg(F.min("p_name").alias("name"))
    # A dictionary is one document.
    R.dictionary_map(names, "code", "name").select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    return tables.read_code_map(t.spark, f"{path}/*.txt")


@query("a10_column_json", "SELECT p_partkey AS row, p_name, p_size FROM part")
def a10(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "columns")
    sinks.write_column_json(t.part, "p_partkey", ["p_name", "p_size"], path, 1000)
    return tables.read_column_json(t.spark, path, {"p_name": "string", "p_size": "int"})


@query("a11_column_lists", "SELECT p_partkey, p_name, p_size FROM part")
def a11(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "lists")
    sinks.write_column_lists(t.part, "p_partkey", ["p_partkey", "p_name", "p_size"], path, 1000)
    return tables.read_column_lists(t.spark, path, {"p_partkey": "bigint", "p_name": "string", "p_size": "int"})


@query("a12_indexed_csv", 'SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS "Index", o_orderkey AS row_id FROM orders')
def a12(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "indexed")
    sinks.write_indexed_csv(t.orders.select(F.col("o_orderkey").alias("row_id")), "row_id", path)
    return tables.read_csv(t.spark, path, "Index bigint, row_id bigint")


@query("a13_parts", "SELECT c_custkey, c_name FROM customer")
def a13(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "parts")
    sinks.write_parts(t.customer.select("c_custkey", "c_name"), 4, path)
    return tables.read_csv(t.spark, f"{path}/part-*.csv", "c_custkey bigint, c_name string")


@query("a14_by_label", "SELECT o_orderkey AS row_id, o_orderpriority AS label FROM orders")
def a14(t: Tables) -> DataFrame:
    """Written in two runs; the second writes only the labels the first left out."""
    path = scratch_path(t.spark, "labels")
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"))
    sinks.write_partitioned(rows.where("label < '3'"), ["label"], path)
    rest = tables.pending_labels(rows, t.spark.read.parquet(path), "label")
    sinks.write_partitioned(rows.join(rest, "label", "left_semi"), ["label"], path)
    return t.spark.read.schema("row_id bigint, label string").parquet(path)


@query(
    "a15_split_files",
    """WITH r AS (SELECT o_orderkey AS row_id, o_orderpriority AS label, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT row_id, CASE WHEN rn <= ceil(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split, label FROM r""",
)
def a15(t: Tables) -> DataFrame:
    """All written files, the split and label taken from their folders."""
    path = scratch_path(t.spark, "split")
    rows = head_split(t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label")), "label", "row_id", 0.8)
    sinks.write_partitioned(rows, ["split", "label"], path)
    return t.spark.read.schema("row_id bigint, split string, label string").parquet(path)


@query(
    "a15_one_split_file",
    """WITH r AS (SELECT o_orderkey AS row_id, o_orderpriority AS label, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT label, CASE WHEN rn <= ceil(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM r GROUP BY ALL""",
)
def a15_one(t: Tables) -> DataFrame:
    """Each split and label read alone, by its folder."""
    back = a15(t)
    parts = back.groupBy("split", "label").agg(S.count_rows().alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    return parts.select("label", "split", "n", "first", "last")


METRICS = """m AS (SELECT l_returnflag AS name, avg(l_discount) AS train, avg(l_tax) AS test, sum(l_quantity) AS train_time, count(*) AS size FROM lineitem GROUP BY 1)"""


def results(t: Tables) -> DataFrame:
    """Result documents: one nested row per run."""
    runs = t.lineitem.groupBy(F.col("l_returnflag").alias("name")).agg(
        F.avg("l_discount").alias("train"), F.avg("l_tax").alias("test"), F.sum("l_quantity").alias("train_time"), S.count_rows().alias("size")
    )
    pair = F.struct("train", "test")
    stats = F.struct("train_time", F.lit(0.0).alias("score_time"), F.col("size").alias("model_size"))
    return runs.select("name", pair.alias("accuracy"), pair.alias("top_2"), pair.alias("top_5"), stats.alias("stats"))


@query("a16_metrics_json", f"WITH {METRICS} SELECT name, round(train, 6) AS train, size FROM m")
def a16(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "metrics")
    results(t).write.json(path)
    back = t.spark.read.schema(GRID_RESULT).json(path)
    return back.select("name", r6(F.col("accuracy.train")).alias("train"), F.col("stats.model_size").alias("size"))


@query("a17_report_csv", """SELECT year(o_orderdate)::INTEGER AS "Run", printf('%.3f', avg(o_totalprice / 1000)) AS "Accuracy" FROM orders GROUP BY 1""")
def a17(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "report")
    table = t.orders.groupBy(F.year("o_orderdate").alias("run")).agg(F.avg(F.col("o_totalprice") / 1000).alias("acc"))
    sinks.write_report(table, path, 3, {"run": "Run", "acc": "Accuracy"})
    return tables.read_csv(t.spark, path, "Run int, Accuracy string")


@query(
    "a18_model_store",
    f"""{nb_sql(label='label')}, g AS (SELECT label, mu, v + 1e-9 * gv AS var FROM cls CROSS JOIN gv)
SELECT 'class' AS kind, label, '' AS name, round(b + 2 * ln(n / total), 6) AS x, round(n, 6) AS y FROM cls CROSS JOIN gv JOIN base USING (label)
UNION ALL SELECT 'weight', label, code, round(ln(p) - ln(1 - p), 6), 0.0::DOUBLE FROM p
UNION ALL SELECT 'gauss', label, 'age', round(mu, 6), round(var, 6) FROM g""",
)
def a18(t: Tables) -> DataFrame:
    """Every number of the stored model: class weights and sizes, token weights, moments."""
    path = scratch_path(t.spark, "model")
    composite(t, training(t, "label")).save(path)
    back = N.BayesModel.load(t.spark, path)
    words = back.dictionary.agg(F.collect_list("token")).scalar()
    grid = back.classes.select("label", "rest", F.explode(words).alias("token")).join(back.weights, ["label", "token"], "left")
    parts = [
        back.classes.select(F.lit("class").alias("kind"), "label", F.lit("").alias("name"), F.col("base").alias("x"), F.col("n").alias("y")),
        grid.select(F.lit("weight").alias("kind"), "label", F.col("token").alias("name"), F.coalesce("w", "rest").alias("x"), F.lit(0.0).alias("y")),
        back.gauss.select(F.lit("gauss").alias("kind"), "label", F.col("feature").alias("name"), F.col("mean").alias("x"), F.col("var").alias("y")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumns({"x": r6(F.col("x")), "y": r6(F.col("y"))})


@query("a19_result_folder", f"WITH {METRICS} SELECT name, round(train, 6) AS train, round(test, 6) AS test, train_time, round(size / 1024 / 1024, 6) AS size_mb FROM m")
def a19(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "results")
    results(t).repartition(3, "name").write.json(path)
    back = tables.read_results(t.spark, f"{path}/*.json", GRID_RESULT)
    return back.select(
        "name", r6(F.col("accuracy.train")).alias("train"), r6(F.col("accuracy.test")).alias("test"), "stats.train_time",
        r6(F.col("stats.model_size") / 1024 / 1024).alias("size_mb"),
    )


@query("a20_outline", "SELECT DISTINCT p_brand AS main, p_name AS part FROM part")
def a20(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "outline")
    blocks = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    blocks.select(F.concat(F.lit("s-"), "p_brand", F.lit("\n"), F.array_join("names", "\n")).alias("value")).write.text(path)
    return tables.read_outline(t.spark, f"{path}/*.txt")


@query(
    "a21_repeated_groups",
    """SELECT p_name AS name, p_brand AS url, p_size AS probability FROM part""",
)
def a21(t: Tables) -> DataFrame:
    """Three groups of four columns of which one is filled; a group without a number is passed over."""
    names = ["name", "url", "note", "probability"]
    cells = [F.col("p_name"), F.col("p_brand"), F.lit(""), F.col("p_size").cast("string")]
    bad = [F.col("p_name"), F.lit(""), F.lit(""), F.lit("many")]
    wide = []
    for g in range(3):
        for k, n in enumerate(names):
            first = F.when(F.col("p_type") == "PROMO", bad[k]).otherwise(cells[k]) if g == 0 else None
            second = F.when(F.col("p_type") == "PROMO", cells[k]).otherwise("") if g == 1 else None
            value = first if g == 0 else second if g == 1 else F.lit("")
            wide.append(value.alias(f"{n}_{g}"))
    path = saved_csv(t.part.select(*wide))
    columns = [f"{n}_{g}" for g in range(3) for n in names]
    text = tables.read_csv(t.spark, path, ", ".join(f"{c} string" for c in columns)).fillna("")

    def valid(g):
        return (g["name"] != "") & (g["url"] != "") & g["probability"].try_cast("int").isNotNull()

    first = text.select(J.repeated_groups(columns, 4, names, valid).alias("g")).where(F.col("g").isNotNull())
    return first.select("g.name", "g.url", F.col("g.probability").cast("int").alias("probability"))


@query("a22_leading_lines", "SELECT s_suppkey AS id, s_acctbal AS amount FROM supplier")
def a22(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "leading")
    lines = t.supplier.select(F.concat_ws(",", F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string")).alias("value"))
    # Several files, the notes first in each.
    files = 4
    notes = t.spark.range(6 * files).select(F.concat(F.lit("% note "), F.col("id").cast("string")).alias("value"), (F.col("id") % files).alias("file"), F.lit(0).alias("kind"))
    dealt = lines.select("value", F.pmod(F.xxhash64("value"), F.lit(files)).alias("file"), F.lit(1).alias("kind"))
    notes.unionByName(dealt).repartitionById(files, F.col("file").cast("int")).sortWithinPartitions("kind").select("value").write.text(path)
    return tables.read_below_lines(t.spark, path, StructType.fromDDL("id bigint, amount double")).select("id", "amount")


@query("a23_run_logs", "SELECT o_orderstatus AS dataset, count(*) AS n FROM orders GROUP BY 1")
def a23(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "logs")
    for status in ("F", "O", "P"):
        t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey").write.option("header", "true").csv(f"{path}/{status}")
    logs = tables.read_csv(t.spark, [f"{path}/{s}" for s in ("F", "O", "P")], "o_orderkey bigint")
    return tables.with_file_stem(logs).groupBy("dataset").agg(S.count_rows().alias("n"))


@query("a24_named_sets", "SELECT CASE o_orderstatus WHEN 'F' THEN 'base' ELSE 'other' END AS dataset, count(*) AS n FROM orders GROUP BY 1")
def a24(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "sets")
    keys = t.orders.select("o_orderkey", "o_orderstatus")
    keys.where("o_orderstatus = 'F'").write.option("header", "true").csv(f"{path}/a")
    keys.where("o_orderstatus <> 'F'").write.option("header", "true").csv(f"{path}/b")
    entries = F.create_map(F.lit("base"), F.lit(f"{path}/a"), F.lit("other"), F.lit(f"{path}/b"))
    t.spark.range(1).select(F.to_json(entries).alias("value")).write.text(f"{path}/driver")
    sets = tables.read_named_sets(t.spark, f"{path}/driver/*.txt", "o_orderkey bigint, o_orderstatus string")
    return sets.groupBy("dataset").agg(S.count_rows().alias("n"))


@query(
    "compact_file",
    f"""{S.BASE} SELECT patient::VARCHAR AS "PATIENT", CASE WHEN gender = 0 THEN 'F' ELSE 'M' END AS "GENDER", label AS "PATHOLOGY", CAST(len(codes) AS INTEGER) AS "NUM_SYMPTOMS", array_to_string(codes, ';') AS "SYMPTOMS"
FROM rec WHERE len(codes) > 0""",
)
def compact_file(t: Tables) -> DataFrame:
    back = tables.read_csv(t.spark, saved_csv(compact(t)), COMPACT)
    return back.where(F.col("NUM_SYMPTOMS") > 0).select("PATIENT", "GENDER", "PATHOLOGY", "NUM_SYMPTOMS", "SYMPTOMS")


@query(
    "compact_to_sparse",
    f"""{S.BASE}, lb AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS li FROM (SELECT DISTINCT label FROM rec)), ix AS (SELECT row_id, array_to_string(list_sort(list(idx)), ',') AS s FROM sym JOIN dic USING (code) GROUP BY 1)
SELECT row_id AS "Index", CAST(li AS INTEGER) AS "LABEL", gender AS "GENDER", race AS "RACE", age AS "AGE", s AS "SYMPTOMS" FROM rec JOIN lb USING (label) JOIN ix USING (row_id)""",
)
def compact_to_sparse(t: Tables) -> DataFrame:
    """The whole way from records to sparse rows in a file and back."""
    labels = R.number_codes(S.conditions(t), "label", "label_idx").withColumnRenamed("code", "label")
    reported = S.records(t).where(F.size("codes") > 0)
    rows = R.with_indices(reported, "codes", S.dictionary(t)).join(labels, "label", "left")
    sparse = rows.select(
        F.col("row_id").alias("Index"), F.col("label_idx").alias("LABEL"), F.col("gender").alias("GENDER"), F.col("race").alias("RACE"), F.col("age").alias("AGE"),
        F.array_join(F.transform("idx", lambda i: i.cast("string")), ",").alias("SYMPTOMS"),
    )
    return tables.read_csv(t.spark, saved_csv(sparse), SPARSE)
