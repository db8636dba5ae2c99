"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores.  Every query runs once to warm up and then BENCH_RUNS times
(default 3); the median counts.  All rows are computed, none are collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from convq.sources.workspace import work_folder
from registry.queries import QUERIES

HEADLINE = [
    "conversation_rollup_doc",
    "totals_by_class_and_quarter_doc",
    "conversation_metadata",
    "length_stats_doc",
    "length_histogram_doc",
    "quarterly_volume",
    "stratified_sample",
    "random_conversations",
    "fetch_by_ids",
    "first_15_messages",
    "transcript_plain",
    "transcript_authored",
    "prefilter_funnel",
    "char_stats",
    "message_flags_doc",
    "message_flags_doc_classic",
    "conversation_flags_conv",
    "conversation_flags_doc",
    "conversation_flags",
    "conversation_flags_pairs_classic",
    "first_occurrence",
    "quality_metrics",
    "issue_report",
    "stratified_metrics",
    "usability_matrix",
    "token_stats",
    "cost_summary",
    "count_tokens",
    "judge_scores",
    "judge_summary",
]


def in_files(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The tables the queries read, as several files each, as they come at scale.

    The given ones are a single row group, which is a single task whatever the cores.
    """
    folder = work_folder(spark, "bench-input")
    for name in ("documents", "conversations", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED", "/tmp/checkpoints"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, folder = {}, in_files(spark, sf_dir, int(cpus))
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
