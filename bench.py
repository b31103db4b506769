"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated
names, default the list below), BENCH_RUNS (default 1 timed run after a warm-up of the session).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lineloom import get_spark  # noqa: E402
from lineloom.catalog import load  # noqa: E402
from lineloom.session import drop_scratch  # noqa: E402

HEADLINE = [
    # curation
    "instrument_apply", "name_canonical", "structural_flag", "metadata_array_join",
    # audit
    "entity_list", "line_coverage", "granularity", "quantile_summary", "observation_rollup", "hash_split_counts",
    # series
    "nearest_time_join", "context_fixed", "lag_persistence",
    # arrays
    "der_snr", "snr_scores", "line_features", "second_line_features", "continuum_agreement",
    # models and evaluation
    "ridge_probe", "forecast_pca_ridge", "forecast_metrics", "recall_at_10", "bootstrap_ratio_interval", "multiseed_summary",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = get_spark("bench", cores, cores)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load().QUERIES
    registry["entity_list"](spark, path).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            registry[name](spark, path).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(path.rstrip("/"))}), flush=True)
    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
