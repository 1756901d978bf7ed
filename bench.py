"""Times the headline queries on the given tables and prints one JSON line.

Derived inputs (task table, event logs, payloads, stored runs) are written first and timed as
``prepare``; every query is then run once to warm up and timed on its second run, its whole result
computed. ``analyze_logs`` is the end-to-end path from log files to findings with nothing reused.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetgauge.plans.analyze import analyze_jobs, fold_event_logs  # noqa: E402
from fleetgauge.session import configure  # noqa: E402
from workload import adapters, catalog  # noqa: E402

HEADLINE = (
    *("scan_event_log", "parse_events", "config_fold", "stage_facts", "task_measures"),
    *("stage_totals", "stage_quantiles", "stage_metrics", "job_metrics", "job_overview"),
    *("hs_stage_metrics", "hs_job", "run_rules", "analyze_jobs", "config_comparison", "compare_jobs"),
    *("list_runs", "latest_run_per_app", "stats_summary", "rule_frequency", "top_issues", "severity_trend"),
    *("filter_new_and_mark", "admit_requests", "run_state", "window_rate", "histogram_quantile", "label_totals"),
)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        # one listing task per core, not one per folder
        .config("spark.sql.sources.parallelPartitionDiscovery.parallelism", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)

    prepare = {
        "tasks": timed(lambda: adapters.lineitem_tasks(spark, sf_dir)),
        "stages": timed(lambda: adapters.fleet_stages(spark, sf_dir)),
        "logs": timed(lambda: adapters.file_logs(spark, sf_dir)),
        "payloads": timed(lambda: adapters.payload_root(spark, sf_dir)),
        "runs": timed(lambda: adapters.stored_runs(spark, sf_dir)),
    }
    seconds = {}
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        run(query(spark, sf_dir))
        seconds[name] = timed(lambda: run(query(spark, sf_dir)))

    logs = adapters.file_logs(spark, sf_dir)
    seconds["analyze_logs"] = timed(lambda: run(analyze_jobs(fold_event_logs(spark, logs).staged())))
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "prepare": prepare,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
