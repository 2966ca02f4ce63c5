"""From the patient, condition and symptom exports to one row per diagnosed condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sizes import settle, small_side


def join_patients(conditions: DataFrame, patients: DataFrame, on: str = "PATIENT", key: str = "Id") -> DataFrame:
    """Conditions with their patient; a condition without one keeps NULLs.

    No broadcast hint: Spark broadcasts the patients only where their size is under its
    threshold, and otherwise sorts and splits hot patients (adaptive skew join).
    """
    renamed = patients.withColumnRenamed(key, "_pk")
    clashes = [c for c in renamed.columns if c in conditions.columns]
    renamed = renamed.withColumnsRenamed({c: f"{c}_patient" for c in clashes})
    return conditions.join(renamed, conditions[on] == renamed["_pk"], "left").drop("_pk")


def join_conditions(symptoms: DataFrame, conditions: DataFrame, on: str = "CONDITION_ID", key: str = "Id") -> DataFrame:
    """Symptom rows with their condition; a clashing symptom column gets the suffix ``_symp``."""
    right = conditions.withColumnRenamed(key, "_ck")
    clashes = [c for c in symptoms.columns if c in right.columns]
    left = symptoms.withColumnsRenamed({c: f"{c}_symp" for c in clashes})
    key_col = f"{on}_symp" if on in clashes else on
    return left.join(right, left[key_col] == right["_ck"], "left").drop("_ck")


def fan_out(parents: DataFrame, facts: DataFrame, key: str, fact_key: str) -> DataFrame:
    """Left join of parents to their facts, where one parent may have a large share of all facts.

    Spark can split a hot key of the right side in an inner join but not in a left one. So the
    matches are an inner join, and the parents without facts (found by the distinct keys, which
    are folded on the map side) are added with NULLs.
    """
    matched = parents.join(facts, F.col(key) == F.col(fact_key))
    keys = facts.select(F.col(fact_key).alias("_fk")).distinct()
    bare = parents.join(keys, F.col(key) == F.col("_fk"), "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def symptom_sets(symptoms: DataFrame, key: str, code: str, out: str = "codes") -> DataFrame:
    """Sorted distinct codes per key.

    Repeats are folded on the map side, so the shuffle and the array per key are bounded by the
    code dictionary however many rows one key has.
    """
    return symptoms.groupBy(key).agg(F.array_sort(F.collect_set(code)).alias(out))


def design_rows(
    conditions: DataFrame, patients: DataFrame, symptoms: DataFrame, key: str, code: str, patient: str, patient_key: str
) -> DataFrame:
    """One row per condition: its own columns, its patient's, and the array of its codes.

    Symptoms are folded before they are joined; the condition key is then unique on both sides.
    """
    sets = symptom_sets(symptoms, key, code).withColumnRenamed(key, "_sk")
    people = patients.withColumnRenamed(patient_key, "_pk")
    joined = conditions.join(sets, conditions[key] == sets["_sk"], "left").join(
        people, F.col(patient) == F.col("_pk"), "left"
    )
    empty = F.array().cast("array<string>")
    return joined.withColumn("codes", F.coalesce("codes", empty)).drop("_sk", "_pk")


def number_codes(df: DataFrame, column: str, out: str = "idx") -> DataFrame:
    """A dictionary of the distinct codes, numbered from 0 in sorted order."""
    codes = df.select(F.col(column).alias("code")).where(F.col("code").isNotNull()).distinct()
    # One row per code of the dictionary; the window sees no fact rows.
    return codes.withColumn(out, F.row_number().over(Window.orderBy("code")) - 1)


def number_by_frequency(df: DataFrame, column: str, keep: int | None = None) -> DataFrame:
    """Codes numbered from 0 by falling frequency (ties by code), optionally the first ``keep``."""
    counts = df.groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    if keep is not None:
        counts = counts.orderBy(F.desc("n"), "code").limit(keep)
    return counts.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), "code")) - 1)


def dictionary_map(dictionary: DataFrame, key: str = "code", value: str = "idx") -> DataFrame:
    """The dictionary folded into one map value, for use as a scalar subquery."""
    return dictionary.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))


def with_indices(df: DataFrame, codes: str, dictionary: DataFrame, out: str = "idx") -> DataFrame:
    """Turn an array of codes into the sorted array of their numbers; unknown codes drop out."""
    mapping = dictionary_map(dictionary).scalar()
    held = df.withColumn("_m", mapping)
    numbers = F.transform(F.array_distinct(codes), lambda c: F.try_element_at(F.col("_m"), c))
    return held.withColumn(out, F.array_sort(F.filter(numbers, lambda i: i.isNotNull()))).drop("_m")


def looked_up(rows: DataFrame, key: str, codes: str, dictionary: DataFrame, value: str, out: str) -> DataFrame:
    """``key, out``: the values that a dictionary of any size (one row a code) has for the list of each row, in the order of the list.

    ``key`` tells the rows apart. Codes are joined to the dictionary, which is broadcast where its counted size allows; the codes of a row
    stay in one task, so the one shuffle is of lists. A repeated code counts once; unknown codes, and those with a NULL value,
    drop out; a row without any known code has an empty list.
    """
    known = small_side(settle(dictionary.select(F.col("code").alias("_code"), F.col(value).alias("_value"))), 32, text_columns=["_code"])
    single = rows.select(F.col(key).alias("_key"), F.posexplode_outer(F.array_distinct(codes)).alias("_at", "_code"))
    found = F.when(F.col("_value").isNotNull(), F.struct("_at", "_value"))
    lists = single.join(known, "_code", "left").groupBy("_key").agg(F.array_sort(F.collect_list(found)).alias("_l"))
    return lists.select(F.col("_key").alias(key), F.col("_l._value").alias(out))


def compact_rows(rows: DataFrame, codes: str = "codes") -> DataFrame:
    """Array of codes to the ``;`` list and count of the compact file."""
    return rows.withColumn("NUM_SYMPTOMS", F.size(codes)).withColumn("SYMPTOMS", F.array_join(codes, ";"))


def wide_flags(rows: DataFrame, codes: str, names: Sequence[str], prefix: str = "") -> DataFrame:
    """One 0/1 column per code; only for short dictionaries at report edges."""
    flags = [F.array_contains(codes, n).cast("int").alias(f"{prefix}{n}") for n in names]
    return rows.select("*", *flags)


def value_pivot(df: DataFrame, key: str, code: str, value: str, order: Column, names: Sequence[str]) -> DataFrame:
    """One column per observation code holding its last value in the given order."""
    picks = [F.max_by(value, F.when(F.col(code) == n, order)).alias(n) for n in names]
    return df.groupBy(key).agg(*picks)


def sparse_columns(df: DataFrame, columns: Sequence[str], least: int) -> list[str]:
    """Names of the columns with fewer than ``least`` values, from one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] < least]


def group_constant(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The value of columns that are constant per key, with a flag where one is not."""
    picks = [F.max(c).alias(c) for c in columns]
    same = [(F.min(c).eqNullSafe(F.max(c))) for c in columns]
    consistent = same[0]
    for s in same[1:]:
        consistent = consistent & s
    return df.groupBy(key).agg(*picks, consistent.cast("int").alias("consistent"))


def merge_keyed(inputs: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """Keyed tables merged, later wins: of a key the row of the last input that has it, in it the one with the highest ``order``.

    All inputs have the same columns. Adds ``input`` (0-based number of the winning one) and ``inputs`` (how many have the key).
    Every input is folded to one row a key before the tables meet, so a key that repeats in many rows is one row
    there; NULL keys are a key like any other. Rows of equal order are told apart by their other columns.
    """
    values = [c for c in inputs[0].columns if c not in keys]
    rest = F.struct(order, *[c for c in values if c != order])
    folded = [df.groupBy(*keys).agg(F.max(rest).alias("_v")).select(*keys, F.lit(i).alias("_i"), "_v") for i, df in enumerate(inputs)]
    whole = folded[0]
    for more in folded[1:]:
        whole = whole.unionByName(more)
    # At most one row an input and key.
    last = whole.groupBy(*keys).agg(F.max(F.struct("_i", "_v")).alias("_m"), F.count(F.lit(1)).alias("inputs"))
    return last.select(*keys, *[F.col(f"_m._v.{c}").alias(c) for c in values], F.col("_m._i").alias("input"), F.col("inputs").cast("int").alias("inputs"))
