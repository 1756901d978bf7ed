"""Task facts to stage and job metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import schemas as S
from fleetgauge.functions.config import config_accessors
from fleetgauge.functions.scalars import gc_time_percent, memory_utilization, skew_ratio, slot_utilization
from fleetgauge.functions.text import array_of, fixed, format_bytes, round_to
from fleetgauge.operators.quantiles import DIGITS, exact_quantiles, quantile_struct, zero_quantiles
from fleetgauge.thresholds import Thresholds

# Per-task measures whose distribution is kept, by the name of the distribution.
LOG_MEASURES = {"duration": "duration_ms", "executor_run_time": "run_ms", "jvm_gc_time": "gc_ms"}


def _totals() -> list[Column]:
    summed = {
        "sum_run_ms": "run_ms",
        "gc_ms": "gc_ms",
        "shuffle_read_bytes": "shuffle_read_bytes",
        "shuffle_write_bytes": "shuffle_write_bytes",
        "spill_disk_bytes": "spill_disk_bytes",
        "spill_memory_bytes": "spill_memory_bytes",
        "input_records": "input_records",
        "output_records": "output_records",
        "shuffle_read_records": "shuffle_read_records",
        "shuffle_write_records": "shuffle_write_records",
    }
    return [
        F.count("*").alias("task_count"),
        *[F.sum(column).alias(name) for name, column in summed.items()],
        F.count_if("failed").alias("failed_tasks"),
        F.count_if("killed").alias("killed_tasks"),
    ]


def stage_totals(tasks: DataFrame, by: str = "app_id") -> DataFrame:
    """Counts and sums per stage; combined map-side, so a hot stage costs one row per map task."""
    return tasks.groupBy(by, "stage_id").agg(*_totals())


def stage_quantiles(
    tasks: DataFrame, by: str = "app_id", measures: dict[str, str] = LOG_MEASURES, digits: int = DIGITS
) -> DataFrame:
    """Exact quantiles per stage, one struct column per measure; ``digits`` is how finely the first read counts."""
    keys = [by, "stage_id"]
    found = exact_quantiles(tasks, keys, measures, digits)
    return found.selectExpr(*keys, *[f"{quantile_struct(f'`{m}`')} AS `{m}`" for m in measures])


def stage_rollup(
    tasks: DataFrame, by: str = "app_id", measures: dict[str, str] = LOG_MEASURES, totals: DataFrame | None = None
) -> DataFrame:
    """Totals and quantiles of every stage; ``totals`` where they are known."""
    known = stage_totals(tasks, by) if totals is None else totals
    return known.join(stage_quantiles(tasks, by, measures), [by, "stage_id"])


def distributions(present: dict[str, str]) -> str:
    """The full ``dist`` record; distributions that were not measured are all zero.

    Keys are ``executor_run_time`` or, inside a group, ``input_metrics.bytes``; values are expressions.
    """

    def pick(path: str) -> str:
        return f"coalesce({present[path]}, {zero_quantiles()})" if path in present else zero_quantiles()

    fields = [f"'{name}', {pick(name)}" for name in S.TOP_QUANTILES]
    for group, names in S.GROUPED_QUANTILES.items():
        inner = ", ".join(f"'{name}', {pick(f'{group}.{name}')}" for name in names)
        fields.append(f"'{group}', named_struct({inner})")
    return f"named_struct({', '.join(fields)})"


def stage_metrics(
    stages: DataFrame,
    tasks: DataFrame,
    by: str = "app_id",
    measures: dict[str, str] = LOG_MEASURES,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Completed stages with the totals of their tasks (``totals``: those of ``stage_totals``, if written before).

    A stage without tasks gets zeros; tasks of a stage that never completed yield no row.
    """
    keys = [by, "stage_id"]
    joined = stages.join(stage_rollup(tasks, by, measures, totals), keys, "left")
    return joined.selectExpr(
        *keys,
        "stage_name",
        *[f"coalesce({name}, 0L) AS {name}" for name in S.STAGE_TOTALS],
        "input_bytes",
        "output_bytes",
        f"{distributions({m: f'`{m}`' for m in measures})} AS dist",
    )


def job_metrics(facts: DataFrame, config: DataFrame, totals: DataFrame, by: str = "log_path") -> DataFrame:
    """One row per job from ``facts`` (with ``duration_ms``), its properties and the ``stage_totals`` of its tasks.

    Task time counts every task, also those of stages that never completed; a log of nothing but tasks is
    a job without a name. An event log holds no executor memory, so those sums are 0.
    """
    task_time = totals.groupBy(by).agg(F.sum("sum_run_ms").alias("task_ms"))
    joined = facts.join(config, by, "left").join(task_time, by, "full")
    known = {"ex_count": "coalesce(executor_count, 0L)", "ex_task_ms": "coalesce(task_ms, 0L)"}
    return joined.selectExpr(
        *([by] if by != "app_id" else []),
        "coalesce(app_id, '') AS app_id",
        "coalesce(app_name, '') AS app_name",
        "coalesce(spark_version, '') AS spark_version",
        "coalesce(duration_ms, 0L) AS duration_ms",
        "coalesce(config, cast(map() AS map<string,string>)) AS config",
        *[f"{known.get(name, '0L')} AS {name}" for name in S.EXECUTOR_COLUMNS],
    )


# Overview sums and the stage columns they add up.
OVERVIEW_SUMS = {
    "total_tasks": "task_count",
    "total_input": "input_bytes",
    "total_shuffle_read": "shuffle_read_bytes",
    "total_shuffle_write": "shuffle_write_bytes",
    "total_spill_disk": "spill_disk_bytes",
    "total_spill_memory": "spill_memory_bytes",
    "total_gc_ms": "gc_ms",
    "total_run_ms": "sum_run_ms",
}


def job_overview(stages: DataFrame, jobs: DataFrame, by: str = "app_id") -> DataFrame:
    """Stage sums per job next to its identity, duration, executor use and main settings; byte sums also as text.

    Slot use is null where it is not defined: no executor, core or elapsed time.
    """
    settings = config_accessors()
    slots = slot_utilization("ex_task_ms", "ex_count", settings["executor_cores"], "duration_ms")
    sums = stages.groupBy(by).agg(
        F.count("*").alias("stage_count"), *[F.sum(c).alias(name) for name, c in OVERVIEW_SUMS.items()]
    )
    joined = jobs.join(sums, by, "left").fillna(0, ["stage_count", *OVERVIEW_SUMS])
    byte_sums = [n for n, c in OVERVIEW_SUMS.items() if c.endswith("_bytes")]
    return joined.selectExpr(
        by,
        "app_name",
        "spark_version",
        "duration_ms",
        f"{round_to('(duration_ms / 60000)', 1)} AS duration_min",
        "stage_count",
        *OVERVIEW_SUMS,
        f"{gc_time_percent('total_gc_ms', 'total_run_ms')} AS gc_percent",
        *[f"{format_bytes(n)} AS {n}_text" for n in byte_sums],
        "ex_count AS executor_count",
        "ex_cores AS executor_cores",
        "ex_failed AS executor_failed_tasks",
        f"{round_to(memory_utilization('ex_peak_mem', 'ex_alloc_mem'), 1)} AS memory_utilization_percent",
        f"{round_to(slots, 1)} AS slot_utilization_percent",
        f"{settings['shuffle_partitions']} AS shuffle_partitions",
        f"{settings['executor_memory']} AS executor_memory",
        f"{settings['executor_cores']} AS cores_per_executor",
    )


def stage_summary(stages: DataFrame, by: str = "app_id") -> DataFrame:
    """Short health line per stage."""
    return stages.selectExpr(
        by,
        "stage_id",
        "stage_name AS name",
        "task_count AS tasks",
        f"if(sum_run_ms > 0, {round_to(gc_time_percent('gc_ms', 'sum_run_ms'), 1)}, 0.0D) AS gc_percent",
        "spill_disk_bytes > 0 AS has_spill",
        "shuffle_read_bytes > 0 OR shuffle_write_bytes > 0 AS has_shuffle",
        f"{round_to(skew_ratio('dist.executor_run_time'), 1)} AS skew_ratio",
        "failed_tasks",
    )


def stage_detail(stages: DataFrame, stage_id: int, app: str | None = None, by: str = "app_id") -> DataFrame:
    """All metrics of one stage id, of one job or of every job; no row means not found."""
    chosen = stages.filter(F.col("stage_id") == stage_id)
    return chosen if app is None else chosen.filter(F.col(by) == app)


def available_stages(stages: DataFrame, by: str = "app_id") -> DataFrame:
    """Stage ids a lookup may ask for."""
    return stages.select(by, "stage_id")


def stage_flags(stages: DataFrame, thresholds: Thresholds = Thresholds(), by: str = "app_id") -> DataFrame:
    """Short flags per stage. Limits are exceeded strictly here, unlike in the rules."""
    t = thresholds
    measured = stages.selectExpr(
        by,
        "stage_id",
        "spill_disk_bytes",
        "failed_tasks",
        "killed_tasks",
        f"{skew_ratio('dist.executor_run_time')} AS skew",
        f"{gc_time_percent('gc_ms', 'sum_run_ms')} AS gc",
    )
    flags = array_of(
        (
            f"if(skew > {t.skew_warning_ratio}D, concat('SKEW(', {fixed('skew', 1)}, 'x)'), NULL)",
            "if(spill_disk_bytes > 0, 'SPILL', NULL)",
            f"if(gc > {t.gc_warning_percent}D, concat('GC(', {fixed('gc', 0)}, '%)'), NULL)",
            f"if(failed_tasks >= {t.task_failure_warning_count}, concat('FAILURES(', failed_tasks, ')'), NULL)",
            "if(killed_tasks > 0, concat('KILLED(', killed_tasks, ')'), NULL)",
        )
    )
    return measured.selectExpr(by, "stage_id", f"array_compact({flags}) AS flags")
