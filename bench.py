"""Times the headline queries and prints one JSON line."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from wavelark.plans import QUERIES

HEADLINE = [
    "beacon_profile_1s", "rssi_temporal_5s", "contextual_features", "desktop_features", "contextual_split", "group_split",
    "balanced_sources", "threshold_calibration", "binary_metrics", "suspicion_summary", "runtime_decisions",
    "session_preflight", "session_overlaps", "tsf_features", "security_posture", "scan_history", "dashboard_overview",
    "isolation_forest", "scaler_transform", "score_distribution", "scenario_evaluation", "normalized_fingerprints",
    "one_class_fit", "kernel_scores", "scan_stream_scoring",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        # The first run only warms the JVM and Python workers up.
        for _ in range(repeats + 1):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(statistics.median(runs[1:] or runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "median warm seconds over headline queries, summed", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
