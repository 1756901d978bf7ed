"""Rules that judge a whole job.

They read one row per job: its own columns, its typed configuration, and a handful of sums over its
stages computed by one map-side combined aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.config import config_accessors
from fleetgauge.functions.scalars import (
    gc_time_percent,
    memory_utilization,
    parse_memory_mb,
    parse_spark_version,
    slot_utilization,
)
from fleetgauge.functions.text import literal, quoted_list
from fleetgauge.plans import texts
from fleetgauge.plans.rule_model import CRITICAL, INFO, WARNING, Case, Rule
from fleetgauge.thresholds import GIB, MIB, Thresholds

# First versions with adaptive execution, and with it on by default.
AQE_INTRODUCED = 3000
AQE_DEFAULT = 3002


def stage_evidence(stages: DataFrame, t: Thresholds, by: str) -> DataFrame:
    """What the job rules need to know about the stages of a job."""
    gc = gc_time_percent("gc_ms", "sum_run_ms")
    pressed = f"sum_run_ms >= {t.gc_min_stage_runtime_ms} AND {gc} > {t.gc_warning_percent}D"
    return stages.groupBy(by).agg(
        F.expr("max(shuffle_read_bytes) AS max_shuffle_read"),
        F.expr("bool_or(shuffle_read_bytes > 0) AS reads_shuffle"),
        F.expr("bool_or(shuffle_read_bytes > 0 OR shuffle_write_bytes > 0) AS has_shuffle"),
        F.expr("bool_or(spill_disk_bytes > 0) AS has_spill"),
        F.expr(f"max({gc}) AS hottest_gc"),
        F.expr(f"bool_or({pressed}) AS gc_pressed"),
    )


def repeated_stage_names(stages: DataFrame, by: str) -> DataFrame:
    """Sorted stage names that occur more than once in a job.

    Occurrences are counted before names are gathered, so a gathered list is as long as the job has
    distinct repeated names; the finding quotes that list in full.
    """
    repeated = stages.groupBy(by, "stage_name").agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.groupBy(by).agg(F.expr("sort_array(collect_list(stage_name)) AS repeated_names"))


def job_evidence(stages: DataFrame, jobs: DataFrame, t: Thresholds, by: str, with_names: bool = True) -> DataFrame:
    """One row per job with everything a job rule looks at."""
    accessors = config_accessors()
    measured = {
        **accessors,
        "version": parse_spark_version("spark_version"),
        "driver_mb": parse_memory_mb(accessors["driver_memory"]),
        "slot_percent": slot_utilization("ex_task_ms", "ex_count", accessors["executor_cores"], "duration_ms"),
        "memory_percent": memory_utilization("ex_peak_mem", "ex_alloc_mem"),
    }
    typed = jobs.selectExpr(by, "duration_ms", "ex_count", *[f"{sql} AS {name}" for name, sql in measured.items()])
    joined = typed.join(stage_evidence(stages, t, by), by, "left")
    if with_names:
        joined = joined.join(repeated_stage_names(stages, by), by, "left")
    return joined.fillna(False, ["reads_shuffle", "has_shuffle", "has_spill", "gc_pressed"])


def shuffle_partitions(t: Thresholds) -> list[Case]:
    """Configured partition count against the largest shuffle; silent where AQE sizes partitions itself."""
    optimal = f"greatest(1L, bigint(max_shuffle_read / {t.target_partition_size_bytes}.0D))"
    ratio = f"(shuffle_partitions / {optimal})"
    judged = f"max_shuffle_read <> 0 AND NOT (aqe_enabled AND coalesce(version >= {AQE_DEFAULT}, false))"
    too_few = f"{judged} AND {ratio} < {t.partition_ratio_min}D"
    too_many = f"{judged} AND {ratio} > {t.partition_ratio_max}D"
    slots = dict(value=ratio, x=f"max_shuffle_read / {GIB}.0D", n="shuffle_partitions", k=optimal)
    return [
        Case(when=f"{too_few} AND aqe_enabled", severity=INFO, texts=texts.TOO_FEW_PARTITIONS_WITH_AQE, **slots),
        Case(when=too_few, severity=WARNING, texts=texts.TOO_FEW_PARTITIONS, **slots),
        Case(when=too_many, severity=INFO, texts=texts.TOO_MANY_PARTITIONS, **slots),
    ]


def executor_idle(t: Thresholds) -> list[Case]:
    """Executor slots mostly idle; dynamic allocation makes it one level less urgent."""
    urgency = f"if(slot_percent < {t.min_slot_utilization_critical_percent}D, {CRITICAL}, {WARNING})"
    return [
        Case(
            when=f"ex_count IS NOT NULL AND duration_ms >= {t.idle_min_job_duration_ms}"
            f" AND slot_percent <= {t.min_slot_utilization_percent}D",
            severity=f"{urgency} + int(dynamic_allocation)",
            texts=texts.EXECUTOR_IDLE,
            value="slot_percent",
            x="100 - slot_percent",
            n="ex_count",
            k="executor_cores",
        )
    ]


def broadcast_join(t: Thresholds) -> list[Case]:
    """Broadcast joins switched off, or allowed only for very small tables."""
    default = t.broadcast_join_default_bytes
    limits = dict(default=default, default_mb=f"{default / MIB:.0f}")
    return [
        Case(
            when="broadcast_threshold = -1",
            severity=f"if(reads_shuffle AND NOT aqe_enabled, {WARNING}, {INFO})",
            texts=texts.BROADCAST_DISABLED.given(**limits),
            value="broadcast_threshold",
        ),
        Case(
            when=f"reads_shuffle AND broadcast_threshold < {default}",
            severity=INFO,
            texts=texts.BROADCAST_LOW.given(**limits),
            value="broadcast_threshold",
            x=f"broadcast_threshold / {MIB}.0D",
        ),
    ]


def serializer_choice(t: Thresholds) -> list[Case]:
    """Java serialization in a job that shuffles."""
    java = "NOT contains(serializer, 'KryoSerializer')"
    return [Case(when=f"{java} AND has_shuffle", severity=INFO, texts=texts.JAVA_SERIALIZER, s="serializer")]


def dynamic_allocation(t: Thresholds) -> list[Case]:
    """Dynamic allocation without bounds, or off while executors idle."""
    no_min, no_max = "if(min_executors = '', 'minExecutors', NULL)", "if(max_executors = '', 'maxExecutors', NULL)"
    setting = "concat('spark.dynamicAllocation.', {}, ' = <value>')".format
    return [
        Case(
            when="dynamic_allocation AND (min_executors = '' OR max_executors = '')",
            severity=WARNING,
            texts=texts.ALLOCATION_UNBOUNDED,
            value="int(min_executors = '') + int(max_executors = '')",
            s=f"concat_ws(', ', {no_min}, {no_max})",
            s2=f"concat_ws(', ', {setting(no_min)}, {setting(no_max)})",
        ),
        Case(
            when="NOT dynamic_allocation AND ex_count IS NOT NULL"
            f" AND slot_percent < {t.min_slot_utilization_percent}D",
            severity=INFO,
            texts=texts.ALLOCATION_SUGGESTED,
            value="slot_percent",
            n="ex_count",
        ),
    ]


def executor_memory_overhead(t: Thresholds) -> list[Case]:
    """Heavy garbage collection while memory is nearly full; short stages count here too."""
    default = literal(texts.DEFAULT_OVERHEAD)
    return [
        Case(
            when=f"ex_count IS NOT NULL AND hottest_gc > {t.memory_overhead_gc_threshold_percent}D"
            f" AND memory_percent >= {t.memory_overhead_mem_utilization_percent}D",
            severity=WARNING,
            texts=texts.MEMORY_PRESSURE,
            value="hottest_gc",
            x="memory_percent",
            s=f"if(executor_memory_overhead = '', {default}, executor_memory_overhead)",
        )
    ]


def driver_memory(t: Thresholds) -> list[Case]:
    """Driver memory outside sensible bounds; a big cluster needs a bigger driver."""
    slots = dict(value="driver_mb", n="driver_mb", k="ex_count", s="driver_memory")
    large_cluster = f"coalesce(ex_count > {t.driver_large_cluster_executor_count}, false)"
    return [
        Case(
            when=f"driver_mb <> 0 AND driver_mb < {t.driver_memory_min_mb}",
            severity=WARNING,
            texts=texts.DRIVER_TOO_SMALL.given(limit=t.driver_memory_min_mb),
            **slots,
        ),
        Case(
            when=f"driver_mb <> 0 AND {large_cluster} AND driver_mb < {t.driver_large_cluster_min_memory_mb}",
            severity=WARNING,
            texts=texts.DRIVER_SMALL_FOR_CLUSTER.given(limit=t.driver_large_cluster_min_memory_mb),
            **slots,
        ),
        Case(
            when=f"driver_mb > {t.driver_memory_max_mb}",
            severity=INFO,
            texts=texts.DRIVER_TOO_LARGE.given(limit=t.driver_memory_max_mb),
            **slots,
        ),
    ]


def memory_underutilization(t: Thresholds) -> list[Case]:
    """Most of the memory never used, with no sign of the opposite problem."""
    return [
        Case(
            when="ex_count IS NOT NULL AND NOT gc_pressed AND NOT has_spill AND memory_percent <> 0"
            f" AND memory_percent < {t.memory_underutilization_percent}D",
            severity=WARNING,
            texts=texts.MEMORY_UNUSED,
            value="memory_percent",
        )
    ]


def aqe_not_enabled(t: Thresholds) -> list[Case]:
    """Adaptive execution off: by explicit choice where it is the default, else merely not opted in."""
    explicit = f"NOT aqe_enabled AND version >= {AQE_DEFAULT} AND aqe_explicit"
    not_opted_in = f"NOT aqe_enabled AND version >= {AQE_INTRODUCED} AND version < {AQE_DEFAULT}"
    return [
        Case(when=explicit, severity=WARNING, texts=texts.AQE_DISABLED, value="version"),
        Case(when=not_opted_in, severity=INFO, texts=texts.AQE_NOT_ENABLED, value="version"),
    ]


def excessive_stages(t: Thresholds) -> list[Case]:
    """Many stage names occur repeatedly, which hints at recomputed lineage."""
    return [
        Case(
            when=f"coalesce(array_size(repeated_names), 0) >= {t.min_duplicate_stages_for_warning}",
            severity=WARNING,
            texts=texts.STAGES_REPEATED,
            value="array_size(repeated_names)",
            n="array_size(repeated_names)",
            s=quoted_list("repeated_names"),
        )
    ]


# Rule ids with their position among all rules.
JOB_RULES = (
    Rule("shuffle_partitions", 3, False, shuffle_partitions),
    Rule("executor_idle", 4, False, executor_idle),
    Rule("broadcast_join", 7, False, broadcast_join),
    Rule("serializer_choice", 8, False, serializer_choice),
    Rule("dynamic_allocation", 9, False, dynamic_allocation),
    Rule("executor_memory_overhead", 10, False, executor_memory_overhead),
    Rule("driver_memory", 11, False, driver_memory),
    Rule("memory_underutilization", 12, False, memory_underutilization),
    Rule("aqe_not_enabled", 13, False, aqe_not_enabled),
    Rule("excessive_stages", 14, False, excessive_stages),
)
