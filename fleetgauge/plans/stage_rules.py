"""Rules that judge one stage at a time."""

from __future__ import annotations

from fleetgauge.functions.scalars import gc_time_percent, skew_ratio
from fleetgauge.plans import texts
from fleetgauge.plans.rule_model import CRITICAL, INFO, WARNING, Case, Rule
from fleetgauge.thresholds import GIB, MIB, Thresholds

READS_ONLY_SHUFFLE = "(shuffle_read_bytes > 0 AND input_bytes = 0)"


def _saved_percent(ratio: str) -> str:
    return f"bigint((1 - 1 / {ratio}) * 100)"


def _graded(critical: str) -> str:
    return f"if({critical}, {CRITICAL}, {WARNING})"


def data_skew(t: Thresholds) -> list[Case]:
    """Slowest task far above the median run time."""
    ratio = skew_ratio("dist.executor_run_time")
    return [
        Case(
            when=f"task_count >= {t.min_task_count_for_skew} AND {ratio} >= {t.skew_warning_ratio}D",
            severity=_graded(f"{ratio} > {t.skew_critical_ratio}D"),
            texts=texts.DATA_SKEW,
            recommended_if_aqe=texts.DATA_SKEW_DESPITE_AQE,
            value=ratio,
            x="dist.executor_run_time.max",
            y="dist.executor_run_time.median",
            n=_saved_percent(ratio),
        )
    ]


def spill_to_disk(t: Thresholds) -> list[Case]:
    """Intermediate data that did not fit in memory; hardly any of it, next to the input, is only a note."""
    gigabytes = f"(spill_disk_bytes / {GIB}.0D)"
    negligible = f"input_bytes > 0 AND try_divide(spill_disk_bytes, input_bytes) < {t.spill_negligible_ratio}D"
    return [
        Case(
            when="spill_disk_bytes <> 0",
            severity=f"CASE WHEN {negligible} THEN {INFO} WHEN {gigabytes} > {t.spill_critical_gb}D THEN {CRITICAL}"
            f" WHEN {gigabytes} > {t.spill_warning_gb}D THEN {WARNING} ELSE {INFO} END",
            texts=texts.SPILL_TO_DISK,
            value=gigabytes,
        )
    ]


def gc_pressure(t: Thresholds) -> list[Case]:
    """Much of the run time spent collecting garbage, in a stage that ran long enough to matter."""
    percent = gc_time_percent("gc_ms", "sum_run_ms")
    return [
        Case(
            when=f"sum_run_ms >= {t.gc_min_stage_runtime_ms} AND {percent} >= {t.gc_warning_percent}D",
            severity=_graded(f"{percent} > {t.gc_critical_percent}D"),
            texts=texts.GC_PRESSURE.given(target=f"{t.gc_target_percent:.0f}"),
            value=percent,
            n=f"bigint({percent} - {t.gc_target_percent}D)",
        )
    ]


def task_failures(t: Thresholds) -> list[Case]:
    """Any failed task."""
    return [
        Case(
            when=f"failed_tasks >= {t.task_failure_warning_count}",
            severity=_graded(f"failed_tasks >= {t.task_failure_critical_count}"),
            texts=texts.TASK_FAILURES,
            value="failed_tasks",
            n="failed_tasks",
            k="task_count",
        )
    ]


def small_files(t: Thresholds) -> list[Case]:
    """Little input per task: the measured median, or the average when no distribution is known."""
    median = "dist.input_metrics.bytes.median"
    average = "try_divide(input_bytes, task_count)"
    per_task = f"if({median} = 0 AND input_bytes > 0 AND task_count > 0, {average}, {median})"
    return [
        Case(
            when=f"NOT {READS_ONLY_SHUFFLE} AND {per_task} <> 0 AND {per_task} < {t.small_file_threshold_bytes}",
            severity=_graded(f"{per_task} < {t.small_file_critical_bytes}"),
            texts=texts.SMALL_FILES,
            value=per_task,
            x=f"{per_task} / {MIB}.0D",
            n="task_count",
        )
    ]


def shuffle_data_volume(t: Thresholds) -> list[Case]:
    """Shuffle output out of proportion to the input, or huge in itself; the ratio wins when both hold."""
    gigabytes = f"(shuffle_write_bytes / {GIB}.0D)"
    ratio = "try_divide(shuffle_write_bytes, input_bytes)"
    return [
        Case(
            when=f"input_bytes > 0 AND {ratio} > {t.shuffle_ratio_warning}D",
            severity=WARNING,
            texts=texts.SHUFFLE_RATIO,
            value=ratio,
            x=gigabytes,
        ),
        Case(
            when=f"{gigabytes} > {t.shuffle_volume_absolute_gb}D",
            severity=WARNING,
            texts=texts.SHUFFLE_VOLUME,
            value=gigabytes,
        ),
    ]


def input_data_skew(t: Thresholds) -> list[Case]:
    """One task reads far more than the median; needs per-task input distributions."""
    read = "dist.input_metrics.bytes"
    ratio = f"try_divide({read}.max, {read}.median)"
    return [
        Case(
            when=f"task_count >= {t.min_task_count_for_skew} AND NOT {READS_ONLY_SHUFFLE}"
            f" AND {read}.median <> 0 AND {ratio} >= {t.input_skew_warning_ratio}D",
            severity=_graded(f"{ratio} >= {t.input_skew_critical_ratio}D"),
            texts=texts.INPUT_SKEW,
            value=ratio,
            x=f"{read}.max",
            y=f"{read}.median",
            n=_saved_percent(ratio),
        )
    ]


# Rule ids with their position among all rules.
STAGE_RULES = (
    Rule("data_skew", 0, True, data_skew),
    Rule("spill_to_disk", 1, True, spill_to_disk),
    Rule("gc_pressure", 2, True, gc_pressure),
    Rule("task_failures", 5, True, task_failures),
    Rule("small_files", 6, True, small_files),
    Rule("shuffle_data_volume", 15, True, shuffle_data_volume),
    Rule("input_data_skew", 16, True, input_data_skew),
)
