"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned and fully executed with the ``noop`` sink (every
row computed, nothing collected). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "dti_segmentation", "clean_and_label", "feature_ratios", "audit_table",
    "default_rate_by_grade", "portfolio_exposure", "correlation_matrix", "boxplot_stats",
    "split_assignment", "roc_auc_gini", "decile_lift", "psi_features", "threshold_sweep",
    "vintage_auc", "label_encoding", "feature_defaults", "validate_applications",
    "drift_numeric", "drift_categorical", "train_boosted", "local_reasons", "score_batch",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from loanlens.plans.registry import queries
    from loanlens.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus))
    names = sys.argv[1:] or list(HEADLINE)
    qs = queries()
    times: dict[str, float] = {}
    # warm-up: JVM, codegen caches and file listing
    qs["overall_default_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        t = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
