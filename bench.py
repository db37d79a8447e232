"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs
per query after one warm-up; the median counts), BENCH_QUERIES (names, comma separated).
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from credlake.workload import QUERIES

HEADLINE = [
    "style_profile",
    "deduplicated_corpus",
    "cleaning_audit",
    "clean_texts",
    "token_counts",
    "term_statistics",
    "tfidf_weights",
    "batch_predictions",
    "merged_search_results",
    "verdict_rows",
    "source_analysis",
    "result_documents",
    "scan_verdicts",
    "model_comparison",
    "roc_auc",
    "article_rows",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("credlake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(name: str, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name in names:
        cold = run(name, spark, sf_dir)
        times[name] = round(statistics.median(run(name, spark, sf_dir) for _ in range(runs)), 3)
        print(f"{name}: first {cold:.2f}s, then {times[name]:.2f}s", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(Path(sf_dir).name.removeprefix("sf") or 0),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
