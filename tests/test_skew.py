"""Queries on tables in which one order, part, customer, class and event type hold a third of the rows."""

import pytest

from anamnesis.plans import catalog
from tests.compare import TABLES, check, duck

SOURCE = "/root/testdata/sf0.001"

HOT = {
    "lineitem": "SELECT * EXCLUDE (h) REPLACE (CASE WHEN h THEN 7 ELSE l_orderkey END AS l_orderkey, CASE WHEN h THEN 3 ELSE l_partkey END AS l_partkey) "
    "FROM (SELECT *, hash(l_orderkey, l_linenumber, l_extendedprice) % 3 = 0 AS h FROM lineitem)",
    "orders": "SELECT * EXCLUDE (h) REPLACE (CASE WHEN h THEN 5 ELSE o_custkey END AS o_custkey, CASE WHEN h THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority) "
    "FROM (SELECT *, hash(o_orderkey) % 3 = 0 AS h FROM orders)",
    "part": "SELECT * EXCLUDE (h) REPLACE (CASE WHEN h THEN 'Brand#1' ELSE p_brand END AS p_brand) FROM (SELECT *, hash(p_partkey) % 3 = 0 AS h FROM part)",
}

NAMES = [
    "design_matrix", "class_symptom_rate", "c1_conditions_patients", "c3_encounter_symptoms", "c4_four_way", "c9_semi_encounters",
    "c12_cooccurrence_graph", "d8_fold_by_key", "d9_reduce_to_vector", "d16_quantiles", "d18_box_stats", "d20_most_common",
    "e3_first_n_per_class", "e6_forward_fill", "f3_except", "g1_stratified_split", "g3_positional_split", "g6_holdout_folds", "g7_kfold",
    "g9_mixed_sources", "i9_mask_of_list", "j6_sheet_blocks", "k1_inject_connected_mean", "k2_inject_hashed_mean", "k5_resample_weighted",
    "l1_sparse_rows", "l9_nominal_default", "m6_composite_top5", "m13_rule_table", "n2_top_n", "n8_auc_one_vs_rest", "n10_threshold_sweep",
    "n14_learning_curve", "o2_cosine_pairs", "o8_wasserstein", "p2_orphans", "p3_symptoms_not_allowed", "s1_incremental_fit", "u7_python_aggregate",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    con = duck(SOURCE)
    for name in TABLES:
        con.execute(f"COPY ({HOT.get(name, f'SELECT * FROM {name}')}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_skewed(spark, folder, name):
    ok, message, _ = check(spark, duck(folder), name, catalog.QUERIES[name], catalog.ORACLES[name], folder)
    assert ok or message == "0 rows equal", message
