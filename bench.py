"""Time the headline queries: ``BENCH_SF_DIR``, ``BENCH_CPUS``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from anamnesis.session import build_session  # noqa: E402

HEADLINE = [
    "design_matrix",
    "class_symptom_rate",
    "compact_to_sparse",
    "c12_cooccurrence_graph",
    "d16_quantiles",
    "e6_forward_fill",
    "g1_stratified_split",
    "g7_kfold",
    "i22_standardise",
    "j9_combination_codes",
    "j11_attribute_records",
    "k1_inject_connected_mean",
    "k5_resample_weighted",
    "l1_sparse_rows",
    "m6_composite_top5",
    "m13_rule_table",
    "n2_top_n",
    "n8_auc_one_vs_rest",
    "n10_threshold_sweep",
    "n14_learning_curve",
    "o2_cosine_pairs",
    "o8_wasserstein",
    "p3_symptoms_not_allowed",
    "s1_incremental_fit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    from anamnesis.plans import catalog

    wanted = sys.argv[1:] or HEADLINE
    # Start the JVM code paths and the Python workers before the clock runs.
    catalog.QUERIES["n2_top_n"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
