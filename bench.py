"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans.catalog import load  # noqa: E402

HEADLINE = [
    "profile_columns", "quality_report", "column_quality", "table_summary", "duplicate_rows", "describe_numeric",
    "stats_summary", "anomaly_all_columns", "anomaly_summary", "anomaly_consensus", "iqr_outliers", "outlier_samples",
    "rolling_zscore", "rolling_blocks", "readiness_score", "dataset_overview", "metadata_changes", "metadata_diff_ext",
    "lineage_edges", "lineage_timeline", "recommendations", "parse_replies", "csv_roundtrip", "stream_window_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    chosen = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in chosen:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
