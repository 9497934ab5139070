"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores  (default: all)

Every query runs twice and the faster run counts: the second one finds a warm
JVM, as a query of a long-running cluster session does.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from lineseek.operators import membership, patterns  # noqa: E402
from lineseek.plans import catalog, catalog_search as cs  # noqa: E402
from lineseek.plans.session import build, scratch_path  # noqa: E402
from lineseek.sources import index  # noqa: E402

HEADLINE = (
    "membership_verdict", "membership_sorted", "membership_hash_only", "index_lookup", "search_substring_ci",
    "search_regex", "search_prefix_batch", "substring_offsets", "multi_pattern_substring", "multi_pattern_regex",
    "batch_search", "casefold_original", "line_index_last", "corpus_profile", "request_validate",
    "service_log_parse", "rate_limit_sliding_log", "rate_limit_token_bucket", "latency_summary",
    "latency_p_exclusive", "latency_p_linear", "latency_histogram50", "latency_boxplot", "rolling_mean_1000",
    "error_rate_alerts", "counter_rate", "alert_resolution", "run_comparison", "request_metrics_60s",
    "stream_metrics_60s", "stream_rate_limit",
)


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build(
        "lineseek-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # local tables are small; let their CPU-bound stages keep all cores
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    times = {}
    for name in HEADLINE:
        times[name] = round(min(seconds(lambda: run(queries[name](spark, sf_dir))) for _ in range(2)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)

    # throughput against a persisted index, comparable to lookups per second
    path = scratch_path(spark, "bench-index")
    lines = cs.doc_lines(spark, sf_dir)
    n_lines = lines.count()
    build_s = seconds(lambda: index.write(lines, path))
    snap = index.read(spark, path)
    n_distinct = snap.count()
    batch = snap.select(F.col("line").alias("query"))  # every distinct line asked once
    lookup_s = min(seconds(lambda: run(membership.lookup(snap, batch))) for _ in range(2))
    regex_s = min(
        seconds(lambda: run(snap.where(F.col("line").rlike("(?Ud)the.*[0-9]+")).select("line"))) for _ in range(2)
    )
    words = cs.words(spark, sf_dir, 8)
    n_words = words.count()
    multi_s = min(
        seconds(lambda: run(patterns.substring_matches(snap.select("line", "first_pos"), words))) for _ in range(2)
    )
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": int(cpus),
                "throughput": {
                    "corpus_lines": n_lines,
                    "index_build_lines_per_s": round(n_lines / build_s),
                    "membership_queries_per_s": round(n_distinct / lookup_s),
                    "regex_lines_per_s": round(n_distinct / regex_s),
                    "patterns": n_words,
                    "pattern_lines_per_s": round(n_words * n_distinct / multi_s),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
