"""Benchmark: run the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed completely (``noop`` sink, nothing collected) after
one untimed warm-up query that starts the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "metrics_pred_actual", "rmsecv_by_fold", "loq_summary", "legacy_msecv",
    "folds_grouped_orders", "stratify_customer", "fold_representativeness",
    "first_derivative", "normalize_norm5_SC", "resample_shifted_axis", "band_normalize",
    "baseline_removal", "gram_by_fold", "ols_from_moments", "knn_cv_grid",
    "apply_model_metrics", "pls_train_report", "linear_train_report", "pls2_report",
    "preprocess_recipes", "tree_train_report", "outlier_iterations", "svr_train_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    from specflow.session import get_session
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    from specflow.catalog import QUERIES

    # warm-up: JVM code paths and Python workers (not timed)
    QUERIES["sensitivity_median_mean"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["baseline_removal"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()

    times = {}
    for name in only or HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
