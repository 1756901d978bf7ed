"""Judging a metric value against the thresholds and explaining it in words."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetgauge.functions.text import format_bytes, grouped, literal
from fleetgauge.thresholds import GIB, Thresholds

# Metric name and what it means.
DESCRIPTIONS = {
    "gc_time_percent": (
        "Percentage of total task execution time spent on JVM garbage collection. "
        "Values above the warning threshold indicate memory pressure — the JVM is spending too much time "
        "reclaiming memory instead of doing useful work. Solution: increase `spark.executor.memory` "
        "or reduce data per partition by increasing `spark.sql.shuffle.partitions`."
    ),
    "spill_to_disk_bytes": (
        "Bytes spilled from memory to disk during shuffle or aggregation operations. "
        "Any spill > 0 means executor memory was insufficient to hold intermediate data. "
        "High spill significantly degrades performance due to disk I/O. "
        "Solution: increase `spark.executor.memory` or increase partition count."
    ),
    "data_skew_ratio": (
        "Ratio of maximum task duration to median task duration within a stage (max/median). "
        "A high ratio indicates data skew — one partition has disproportionately more data. "
        "This causes stragglers that delay the entire stage. "
        "Solution: enable AQE skew join (`spark.sql.adaptive.skewJoin.enabled=true`) or salt join keys."
    ),
    "shuffle_read_bytes": (
        "Total bytes read during shuffle (data exchange between stages). "
        "Large shuffle volumes indicate heavy data movement across the network. "
        "Target partition size: ~128MB. Use this to calculate optimal `spark.sql.shuffle.partitions`."
    ),
    "shuffle_write_bytes": (
        "Total bytes written during shuffle output. This data will be read by the next stage. "
        "High shuffle write combined with many partitions may indicate over-partitioning."
    ),
    "executor_count": (
        "Number of executor JVM processes running the job. Each executor has its own memory and cores. "
        "Too many executors with low utilization wastes cluster resources. "
        "Too few may cause long task queues."
    ),
    "memory_utilization_percent": (
        "Ratio of peak memory used to total allocated memory across all executors. "
        "Low utilization (< 40%) means over-provisioned memory. "
        "High utilization combined with GC pressure suggests memory increase needed."
    ),
    "task_count": (
        "Number of tasks in a stage, determined by the number of partitions. "
        "Too few tasks means large partitions and potential OOM. "
        "Too many tasks means high scheduling overhead. Target: ~128MB per partition."
    ),
    "input_bytes": (
        "Total bytes read from input sources (files, tables). "
        "Small input per task (< 10MB) indicates too many small files or over-partitioning. "
        "Consider using `coalesce()` or increasing `spark.sql.files.maxPartitionBytes`."
    ),
    "duration_ms": (
        "Total wall-clock duration of the Spark application in milliseconds. "
        "This includes all stages, scheduling overhead, and idle time between stages."
    ),
    "slot_utilization_percent": (
        "Percentage of available executor slots (cores x time) that were actively running tasks. "
        "Low utilization means the cluster is over-provisioned — paying for compute that sits idle. "
        "Consider reducing executor count, enabling dynamic allocation, or increasing parallelism."
    ),
}


def assessment_limits(t: Thresholds) -> dict[str, tuple[float, float]]:
    """Warning and critical limit of each metric that is judged at all."""
    return {
        "gc_time_percent": (t.gc_warning_percent, t.gc_critical_percent),
        "spill_to_disk_bytes": (t.spill_warning_gb * GIB, t.spill_critical_gb * GIB),
        "data_skew_ratio": (t.skew_warning_ratio, t.skew_critical_ratio),
        "memory_utilization_percent": (
            t.memory_overhead_mem_utilization_percent,
            t.memory_utilization_critical_percent,
        ),
    }


def assess_metric(name: str, value: str, thresholds: Thresholds = Thresholds()) -> str:
    """Critical / Warning / Healthy sentence for a judged metric, empty text for any other."""
    cases = []
    for metric, (warning, critical) in assessment_limits(thresholds).items():
        for limit, sentence in (
            (critical, f"**Critical** — value exceeds the critical threshold ({critical:g})"),
            (warning, f"**Warning** — value exceeds the warning threshold ({warning:g})"),
        ):
            cases.append(f"WHEN {name} = {literal(metric)} AND {value} >= {limit}D THEN {literal(sentence)}")
        cases.append(f"WHEN {name} = {literal(metric)} THEN '**Healthy** — value is within normal range'")
    return f"CASE {' '.join(cases)} ELSE '' END"


def explain_metric(
    metrics: DataFrame, thresholds: Thresholds = Thresholds(), name: str = "metric_name", value: str = "value"
) -> DataFrame:
    """Adds ``known``, ``formatted_value``, ``description``, ``assessment`` and the full ``explanation``."""
    lookup = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in DESCRIPTIONS.items())
    known_names = ", ".join(f"`{n}`" for n in sorted(DESCRIPTIONS))
    formatted = f"if(contains({name}, 'bytes'), {format_bytes(f'bigint({value})')}, {grouped(value, 2)})"
    described = metrics.selectExpr(
        "*",
        f"try_element_at(map({lookup}), {name}) AS description",
        f"{formatted} AS formatted_value",
        f"{assess_metric(name, value, thresholds)} AS assessment",
    )
    body = (
        f"concat('## Metric: `', {name}, '`\\n\\n**Value:** ', formatted_value, '\\n\\n', description,"
        " if(assessment = '', '', concat('\\n\\n### Assessment\\n\\n', assessment)))"
    )
    unknown = f"concat('Unknown metric: `', {name}, {literal(f'`. Known metrics: {known_names}')})"
    return described.selectExpr(
        "*",
        "description IS NOT NULL AS known",
        f"if(description IS NOT NULL, {body}, {unknown}) AS explanation",
    )
