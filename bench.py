"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed end to end: building it (iterative solvers run their Spark passes here)
and materializing its result with the ``noop`` sink (full execution, nothing collected).
A small untimed warm-up starts the JVM code paths and Python workers first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # solvers (V1-V7) and their reports
    "fista_lasso", "fista_backtracking", "fista_lhalf", "fista_lasso_embeddings", "apg_restart", "admm_rows",
    "admm_momentum_rows", "admm_drawback_rows", "loss_history", "holdout_l1",
    # linear-algebra kernels, both layouts
    "matvec_rows", "grad_rows", "matvec_cols", "grad_cols",
    # sources and preparation
    "parse_dense_text", "column_layout", "libsvm_roundtrip", "index_categories", "one_hot_drop_last",
    "assemble_features", "normalize_rows", "hash_split_60_40", "vector_sum",
    # evaluation
    "auc_scores", "pr_scores", "metrics_by_threshold", "multiclass_metrics", "regression_metrics",
    # learners
    "logit_lbfgs_binary", "logit_elastic_net", "predict_score", "predict_class", "dt_bank", "xgb_house",
    "boost_histogram",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from proxlab.plans.registry import load_all
    from proxlab.session import get_spark

    spark = get_spark(f"local[{cpus}]", app="proxlab-bench", shuffle_partitions=int(cpus) * 2)
    queries, _ = load_all()
    # untimed warm-up: JVM code paths and Python workers start once, not inside the first query
    from proxlab.session import ship_package
    ship_package(spark)
    spark.range(100_000).selectExpr("sum(id) AS s").collect()
    spark.range(1000).mapInArrow(lambda it: it, "id long").count()
    times = {}
    for name in only or HEADLINE:
        t0 = time.perf_counter()
        df = queries[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
