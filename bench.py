"""Headline timings: prints one JSON line. Tables derived by earlier queries are dropped before each run."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "stage_b_s", "stage_b_q", "lifetime_build", "outcomes_by_symbol", "validate_report", "midprice",
    "fill_rate_bins_usd", "stage_a", "sink_merge", "pipeline_run", "spearman_lineitem", "kendall_tau_lineitem",
    "dist_moments_lineitem", "ks_normal_lineitem", "qq_normal_lineitem", "hill_curve_lineitem", "mahalanobis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("orderweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from orderweave.plans.catalog import forget, load_all

    registry = load_all()
    only = sys.argv[1:]
    seconds = {}
    for name in HEADLINE if not only else only:
        times = []
        for _ in range(runs):
            forget()
            start = time.perf_counter()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, inputs derived anew, median of runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
