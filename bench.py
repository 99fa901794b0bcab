"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the number of cores. Each query runs
once to warm up and then ``BENCH_RUNS`` times; the median counts. Results are computed in full
and thrown away by the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.compare import session
from checks.queries import QUERIES

HEADLINE = [
    "apply_changes",
    "chunk_plan",
    "database_sizes",
    "dump_all_counts",
    "dump_current",
    "dump_history",
    "dump_per_database",
    "filter_qualified",
    "historic_estimate",
    "insert_sql_extended",
    "invalid_views",
    "pack_totals",
    "purge_on_demand",
    "restore_orders",
    "retention_plan",
    "run_report",
    "safe_name",
    "stream_apply",
    "stream_dump_counts",
    "validate_settings",
]


def timed(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 3)
    result = {
        "metric": "headline queries, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
