"""Derived ratios and parsers used across metrics, rules and reports."""

from __future__ import annotations

from fleetgauge.functions.text import round_to
from fleetgauge.thresholds import MIB

# Memory text such as "4g", "512 MB" or "2048", and the leading part of a version.
MEMORY_PATTERN = r"'(?i)^(\\d+(?:\\.\\d+)?)\\s*([kmgt])?b?$'"
VERSION_PATTERN = r"'^(\\d+)\\.(\\d+)'"


def _ratio(numerator: str, denominator: str) -> str:
    """Quotient, 0 when the denominator is 0."""
    return f"if({denominator} = 0, 0.0D, {numerator} / {denominator})"


def skew_ratio(quantiles: str) -> str:
    """max / median of a quantile struct, 0 when the median is 0."""
    return _ratio(f"{quantiles}.max", f"{quantiles}.median")


def iqr(quantiles: str) -> str:
    """Interquartile range, never negative."""
    return f"greatest(0.0D, {quantiles}.p75 - {quantiles}.p25)"


def gc_time_percent(gc_ms: str, run_ms: str) -> str:
    return f"({_ratio(gc_ms, run_ms)} * 100)"


def memory_utilization(peak: str, allocated: str) -> str:
    return f"({_ratio(peak, allocated)} * 100)"


def slot_utilization(task_ms: str, executors: str, cores: str, duration_ms: str) -> str:
    """Percent of executor slots busy; null when there is no executor, core or elapsed time."""
    slot_ms = f"(double({executors}) * {cores} * {duration_ms})"
    usable = f"{executors} <> 0 AND {cores} > 0 AND {duration_ms} > 0"
    return f"if({usable}, {task_ms} / {slot_ms} * 100, NULL)"


def slot_utilization_total_cores(task_ms: str, executors: str, cores: str, total_cores: str, duration_ms: str) -> str:
    """Slot use over the reported total cores, or executors x configured cores when none is reported."""
    slot_ms = f"(double(if({total_cores} > 0, {total_cores}, {cores} * {executors})) * {duration_ms})"
    return f"if({slot_ms} > 0 AND {task_ms} > 0, {task_ms} / {slot_ms} * 100, NULL)"


def _number_and_unit(value: str) -> tuple[str, str]:
    number = f"try_cast(regexp_extract(trim({value}), {MEMORY_PATTERN}, 1) AS double)"
    return number, f"lower(regexp_extract(trim({value}), {MEMORY_PATTERN}, 2))"


def parse_memory_mb(value: str) -> str:
    """Megabytes of a memory setting, truncated; 0 when absent or malformed, at least 1 for KB."""
    number, unit = _number_and_unit(value)
    return (
        f"coalesce(CASE {unit} WHEN 'k' THEN greatest(1L, bigint({number} / 1024))"
        f" WHEN 'g' THEN bigint({number} * 1024) WHEN 't' THEN bigint({number} * 1048576)"
        f" ELSE bigint({number}) END, 0L)"
    )


def parse_byte_size(value: str) -> str:
    """Bytes of a size setting: a plain integer is bytes, a unit suffix multiplies; else null."""
    number, unit = _number_and_unit(value)
    power = f"CASE {unit} WHEN 'k' THEN 1 WHEN 'm' THEN 2 WHEN 'g' THEN 3 WHEN 't' THEN 4 ELSE 0 END"
    return f"coalesce(try_cast(trim({value}) AS bigint), bigint({number} * pow(1024.0D, {power})))"


def parse_spark_version(version: str) -> str:
    """Leading ``major.minor`` as major*1000+minor, null when the text does not start so."""
    major, minor = (f"try_cast(regexp_extract(trim({version}), {VERSION_PATTERN}, {i}) AS int)" for i in (1, 2))
    return f"({major} * 1000 + {minor})"


def optimal_partitions(total_bytes: str, target_mb: int) -> str:
    """Partitions of ``target_mb`` needed for ``total_bytes``, rounded up, at least 1."""
    return f"if({total_bytes} > 0, greatest(1L, bigint(ceil({total_bytes} / {target_mb * MIB}.0D))), 1L)"


def partition_size_mb(total_bytes: str, partitions: str) -> str:
    """Resulting partition size in MiB, one decimal."""
    return round_to(f"({total_bytes} / ({partitions} * {MIB}.0D))", 1)
