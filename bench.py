"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is timed end to end - plan construction (including any
intermediate tables it writes) plus full execution into Spark's ``noop``
sink, so no result travels to the driver. Every headline query first runs
once, untimed, on the sf0.001 tables to warm the JVM. Shared derived tables
are forgotten before each query, so each time stands alone.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scan_obs_long", "clean_observations", "processing_compare", "cleaning_audit", "value_counts_top20",
    "describe_numeric", "histogram_30", "value_quantiles", "box_stats", "top_locations_by_median",
    "total_series", "pivot_statistics", "winsorize_by_location", "trend_fit", "ols_inference",
    "ridge_grid_cv", "ridge_holdout_metrics", "learning_curve", "newey_west", "residual_acf",
    "normality_tests", "residual_kde", "pooled_model_comparison",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from furrow.plans import QUERIES
    from furrow.plans.queries import clear_prepared
    from furrow.session import get_session
    spark = get_session(f"local[{cpus}]", int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2)),
                        extra={"spark.driver.memory": "16g"})
    # JVM warm-up (code generation, JIT) on the smallest tables, untimed
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and warm_dir.rstrip("/") != sf_dir:
        for n in names:
            QUERIES[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
    # every query pays for the derived tables it needs
    times = {}
    for n in names:
        clear_prepared()
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
        print(f"# {n}: {times[n]} s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir}))


if __name__ == "__main__":
    main()
