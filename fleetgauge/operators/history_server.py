"""Saved History Server payloads to the same stage and job tables the event logs give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import schemas as S
from fleetgauge.operators.metrics import distributions
from fleetgauge.schemas import QUANTILE_SLOTS

NANOS_PER_MS = 1_000_000

# Our stage columns and the payload fields they come from.
STAGE_FIELDS = {
    "task_count": "numTasks",
    "sum_run_ms": "executorRunTime",
    "gc_ms": "jvmGcTime",
    "shuffle_read_bytes": "shuffleReadBytes",
    "shuffle_write_bytes": "shuffleWriteBytes",
    "spill_disk_bytes": "diskBytesSpilled",
    "spill_memory_bytes": "memoryBytesSpilled",
    "failed_tasks": "numFailedTasks",
    "killed_tasks": "numKilledTasks",
    "input_bytes": "inputBytes",
    "input_records": "inputRecords",
    "output_bytes": "outputBytes",
    "output_records": "outputRecords",
    "shuffle_read_records": "shuffleReadRecords",
    "shuffle_write_records": "shuffleWriteRecords",
}
# Our distributions and the task-summary fields they come from.
SUMMARY_FIELDS = {
    "duration": "duration",
    "executor_deserialize_time": "executorDeserializeTime",
    "executor_deserialize_cpu_time": "executorDeserializeCpuTime",
    "executor_run_time": "executorRunTime",
    "executor_cpu_time": "executorCpuTime",
    "scheduler_delay": "schedulerDelay",
    "getting_result_time": "gettingResultTime",
    "result_serialization_time": "resultSerializationTime",
    "jvm_gc_time": "jvmGcTime",
    "result_size": "resultSize",
    "peak_execution_memory": "peakExecutionMemory",
    "memory_bytes_spilled": "memoryBytesSpilled",
    "disk_bytes_spilled": "diskBytesSpilled",
    "input_metrics.bytes": "inputMetrics.bytesRead",
    "input_metrics.records": "inputMetrics.recordsRead",
    "output_metrics.bytes": "outputMetrics.bytesWritten",
    "output_metrics.records": "outputMetrics.recordsWritten",
    "shuffle_read_metrics.read_bytes": "shuffleReadMetrics.readBytes",
    "shuffle_read_metrics.read_records": "shuffleReadMetrics.readRecords",
    "shuffle_read_metrics.remote_blocks_fetched": "shuffleReadMetrics.remoteBlocksFetched",
    "shuffle_read_metrics.local_blocks_fetched": "shuffleReadMetrics.localBlocksFetched",
    "shuffle_read_metrics.total_blocks_fetched": "shuffleReadMetrics.totalBlocksFetched",
    "shuffle_read_metrics.fetch_wait_time": "shuffleReadMetrics.fetchWaitTime",
    "shuffle_read_metrics.remote_bytes_read": "shuffleReadMetrics.remoteBytesRead",
    "shuffle_read_metrics.remote_bytes_read_to_disk": "shuffleReadMetrics.remoteBytesReadToDisk",
    "shuffle_write_metrics.write_bytes": "shuffleWriteMetrics.writeBytes",
    "shuffle_write_metrics.write_records": "shuffleWriteMetrics.writeRecords",
    "shuffle_write_metrics.write_time": "shuffleWriteMetrics.writeTime",
}
# Summaries reported in nanoseconds.
NANOSECOND_FIELDS = ("executorDeserializeCpuTime", "executorCpuTime", "shuffleWriteMetrics.writeTime")


def hs_dedup_stages(stages: DataFrame) -> DataFrame:
    """Latest attempt of every stage; among equal attempts the first listed.

    ``pos`` orders a job's stages; the kept row carries the position where its stage was first listed.
    """
    attempt = F.coalesce("attemptId", F.lit(0).cast("bigint"))
    newest_first_listed = F.struct(attempt.alias("attempt"), (-F.col("pos")).alias("earliest"))
    row = F.struct(*[F.col(c) for c in stages.columns if c != "pos"])
    kept = stages.groupBy("app_id", "stageId").agg(
        F.max_by(row, newest_first_listed).alias("row"), F.min("pos").alias("pos")
    )
    return kept.select("row.*", "pos")


def hs_quantiles(slots: str, divisor: int = 1) -> str:
    """Five-slot array as a struct: a short array repeats its last value, absent or non-numeric is 0."""
    last = f"size({slots}) - 1"
    fields = ", ".join(
        f"'{name}', coalesce(try_cast(get({slots}, least({i}, {last})) AS double), 0.0D) / {divisor}.0D"
        for i, name in enumerate(QUANTILE_SLOTS)
    )
    return f"named_struct({fields})"


def task_distributions(summary: str = "summary") -> str:
    """The ``dist`` record of a task summary struct."""
    return distributions(
        {
            name: hs_quantiles(f"{summary}.{path}", NANOS_PER_MS if path in NANOSECOND_FIELDS else 1)
            for name, path in SUMMARY_FIELDS.items()
        }
    )


def hs_stage_metrics(stages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Stage table from de-duplicated stages and the task summaries of their attempts."""
    attempt = "coalesce(attemptId, 0L) AS attempt"
    fields = [f.name for f in S.TASK_SUMMARY.fields if f.name not in ("stageId", "attemptId")]
    stage_rows = stages.selectExpr("*", "stageId AS stage_id", attempt)
    summary_rows = summaries.selectExpr(
        "app_id", "stageId AS stage_id", attempt, f"struct({', '.join(fields)}) AS summary"
    )
    joined = stage_rows.join(summary_rows, ["app_id", "stage_id", "attempt"], "left")
    return joined.selectExpr(
        "app_id",
        "stage_id",
        "coalesce(name, concat('Stage ', stage_id)) AS stage_name",
        *[f"coalesce({source}, 0L) AS {target}" for target, source in STAGE_FIELDS.items()],
        f"{task_distributions()} AS dist",
        "pos AS stage_pos",
    )


# Executor sums and the payload fields they add up.
EXECUTOR_FIELDS = {
    "ex_peak_mem": "peakMemoryMetrics.JVMHeapMemory",
    "ex_alloc_mem": "maxMemory",
    "ex_task_ms": "totalDuration",
    "ex_gc_ms": "totalGCTime",
    "ex_shuffle_read": "totalShuffleRead",
    "ex_shuffle_write": "totalShuffleWrite",
    "ex_failed": "failedTasks",
    "ex_cores": "totalCores",
}


def hs_executors(executors: DataFrame) -> DataFrame:
    """Executor sums per job, the driver left out."""
    workers = executors.filter("coalesce(id <> 'driver', true)")
    sums = [F.expr(f"sum(coalesce({field}, 0L)) AS {name}") for name, field in EXECUTOR_FIELDS.items()]
    return workers.groupBy("app_id").agg(F.count("*").alias("ex_count"), *sums)


def hs_environment(environments: DataFrame) -> DataFrame:
    """One property map per job; pairs shorter than two are skipped and a later pair replaces an earlier.

    The pairs are one array of one payload row, so the fold stays inside the row.
    """
    slim = environments.selectExpr("app_id", "filter(sparkProperties, p -> size(p) >= 2) AS pairs")
    slim = slim.selectExpr("app_id", "pairs", "reverse(transform(pairs, p -> p[0])) AS newest_first")
    is_last = "i + array_position(newest_first, p[0]) = size(pairs)"
    entries = f"transform(filter(pairs, (p, i) -> {is_last}), p -> struct(p[0] AS key, p[1] AS value))"
    return slim.selectExpr("app_id", f"map_from_entries({entries}) AS config")


def latest_attempt(attempts: str = "attempts") -> str:
    """Last listed attempt, null when there is none."""
    return f"try_element_at({attempts}, -1)"


def base_path(app_id: str = "id", attempts: str = "attempts") -> str:
    """Address of an application's payloads; an attempt id, when set, is part of it."""
    attempt_id = f"coalesce({latest_attempt(attempts)}.attemptId, '')"
    return f"concat('/applications/', {app_id}, if({attempt_id} = '', '', concat('/', {attempt_id})))"


def hs_job(applications: DataFrame, environments: DataFrame, executors: DataFrame) -> DataFrame:
    """Job table: latest attempt, properties and executor sums; parts that were not saved count as empty."""
    jobs = applications.selectExpr(
        "id AS app_id",
        "coalesce(name, '') AS app_name",
        f"coalesce({latest_attempt()}.appSparkVersion, '') AS spark_version",
        f"coalesce({latest_attempt()}.duration, 0L) AS duration_ms",
    )
    joined = jobs.join(hs_environment(environments), "app_id", "left").join(hs_executors(executors), "app_id", "left")
    return joined.selectExpr(
        "app_id",
        "app_name",
        "spark_version",
        "duration_ms",
        "coalesce(config, cast(map() AS map<string,string>)) AS config",
        *[f"coalesce({c}, 0L) AS {c}" for c in S.EXECUTOR_COLUMNS],
    )
