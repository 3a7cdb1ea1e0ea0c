"""Wall seconds of headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "weekly_rollup", "weekly_base", "weekly_features", "run_all_checks", "contract_audit", "fold_rows",
    "score_ledger_macro", "common_cohort_scores", "cluster_bootstrap", "hierarchical_mean", "analog_metadata",
    "chronological_eligibility", "parity_twfe", "was_exact_match", "same_weekday_stats", "seasonal_decomposition",
    "stream_weekly_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    from tidepanel.plans import QUERIES
    from tidepanel.session import build_session

    spark = build_session("bench", f"local[{cpus}]", cpus, os.environ.get("BENCH_DRIVER_MEMORY", "4g"))
    spark.sparkContext.setLogLevel("ERROR")
    # Warm the JVM and the file cache with a query that is not timed.
    QUERIES["distinct_attrs"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
