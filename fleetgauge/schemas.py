"""Declared schemas of the inputs. Nothing is inferred; absent fields are null."""

from __future__ import annotations

from pyspark.sql import types as T

BIG = T.LongType()
TEXT = T.StringType()
FLAG = T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def _named(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


# The listener event types that carry facts.
APPLICATION_START = "SparkListenerApplicationStart"
APPLICATION_END = "SparkListenerApplicationEnd"
LOG_START = "SparkListenerLogStart"
ENVIRONMENT_UPDATE = "SparkListenerEnvironmentUpdate"
STAGE_COMPLETED = "SparkListenerStageCompleted"
TASK_END = "SparkListenerTaskEnd"
EXECUTOR_ADDED = "SparkListenerExecutorAdded"
EVENT_TYPES = (
    APPLICATION_START,
    APPLICATION_END,
    LOG_START,
    ENVIRONMENT_UPDATE,
    STAGE_COMPLETED,
    TASK_END,
    EXECUTOR_ADDED,
)

EVENT = _named(
    ("Event", TEXT),
    ("Spark Version", TEXT),
    ("App ID", TEXT),
    ("App Name", TEXT),
    ("Timestamp", BIG),
    ("Spark Properties", T.MapType(TEXT, TEXT)),
    (
        "Stage Info",
        _named(
            ("Stage ID", BIG),
            ("Stage Name", TEXT),
            ("Submission Time", BIG),
            ("Completion Time", BIG),
            ("Accumulables", T.ArrayType(_named(("Name", TEXT), ("Value", TEXT)))),
        ),
    ),
    ("Stage ID", BIG),
    ("Task End Reason", _named(("Reason", TEXT))),
    ("Task Info", _named(("Launch Time", BIG), ("Finish Time", BIG), ("Failed", FLAG))),
    (
        "Task Metrics",
        _named(
            ("Executor Run Time", BIG),
            ("JVM GC Time", BIG),
            ("Disk Bytes Spilled", BIG),
            ("Memory Bytes Spilled", BIG),
            (
                "Shuffle Read Metrics",
                _named(("Remote Bytes Read", BIG), ("Local Bytes Read", BIG), ("Total Records Read", BIG)),
            ),
            ("Shuffle Write Metrics", _named(("Shuffle Bytes Written", BIG), ("Shuffle Records Written", BIG))),
            ("Input Metrics", _named(("Records Read", BIG))),
            ("Output Metrics", _named(("Records Written", BIG))),
        ),
    ),
)

ATTEMPT = _struct(
    attemptId=TEXT,
    startTime=TEXT,
    endTime=TEXT,
    lastUpdated=TEXT,
    duration=BIG,
    sparkUser=TEXT,
    completed=FLAG,
    appSparkVersion=TEXT,
    logPath=TEXT,
    startTimeEpoch=BIG,
    endTimeEpoch=BIG,
    lastUpdatedEpoch=BIG,
)
APPLICATION = _struct(id=TEXT, name=TEXT, driverHost=TEXT, attempts=T.ArrayType(ATTEMPT))
ENVIRONMENT = _struct(sparkProperties=T.ArrayType(T.ArrayType(TEXT)))
HISTORY_STAGE = _struct(
    status=TEXT,
    stageId=BIG,
    attemptId=BIG,
    name=TEXT,
    numTasks=BIG,
    executorRunTime=BIG,
    jvmGcTime=BIG,
    shuffleReadBytes=BIG,
    shuffleReadRecords=BIG,
    shuffleWriteBytes=BIG,
    shuffleWriteRecords=BIG,
    diskBytesSpilled=BIG,
    memoryBytesSpilled=BIG,
    numFailedTasks=BIG,
    numKilledTasks=BIG,
    inputBytes=BIG,
    inputRecords=BIG,
    outputBytes=BIG,
    outputRecords=BIG,
)
# Slots are read as text so that a non-numeric one becomes 0 instead of spoiling the record.
SLOTS = T.ArrayType(TEXT)
TASK_SUMMARY = _struct(
    stageId=BIG,
    attemptId=BIG,
    duration=SLOTS,
    executorDeserializeTime=SLOTS,
    executorDeserializeCpuTime=SLOTS,
    executorRunTime=SLOTS,
    executorCpuTime=SLOTS,
    resultSize=SLOTS,
    jvmGcTime=SLOTS,
    resultSerializationTime=SLOTS,
    gettingResultTime=SLOTS,
    schedulerDelay=SLOTS,
    peakExecutionMemory=SLOTS,
    memoryBytesSpilled=SLOTS,
    diskBytesSpilled=SLOTS,
    inputMetrics=_struct(bytesRead=SLOTS, recordsRead=SLOTS),
    outputMetrics=_struct(bytesWritten=SLOTS, recordsWritten=SLOTS),
    shuffleReadMetrics=_struct(
        readBytes=SLOTS,
        readRecords=SLOTS,
        remoteBlocksFetched=SLOTS,
        localBlocksFetched=SLOTS,
        totalBlocksFetched=SLOTS,
        fetchWaitTime=SLOTS,
        remoteBytesRead=SLOTS,
        remoteBytesReadToDisk=SLOTS,
    ),
    shuffleWriteMetrics=_struct(writeBytes=SLOTS, writeRecords=SLOTS, writeTime=SLOTS),
)
EXECUTOR = _struct(
    id=TEXT,
    maxMemory=BIG,
    totalDuration=BIG,
    totalGCTime=BIG,
    totalShuffleRead=BIG,
    totalShuffleWrite=BIG,
    failedTasks=BIG,
    totalCores=BIG,
    peakMemoryMetrics=_struct(JVMHeapMemory=BIG),
)

FINDING = _struct(
    rule_id=TEXT,
    severity=TEXT,
    title=TEXT,
    message=TEXT,
    stage_id=BIG,
    current_value=TEXT,
    recommended_value=TEXT,
    estimated_impact=TEXT,
)
RECOMMENDATION = _struct(
    priority=BIG,
    title=TEXT,
    parameter=TEXT,
    current_value=TEXT,
    recommended_value=TEXT,
    explanation=TEXT,
    estimated_impact=TEXT,
    risk=TEXT,
)
REPORT = _struct(
    app_id=TEXT,
    summary=TEXT,
    severity=TEXT,
    rule_results=T.ArrayType(FINDING),
    recommendations=T.ArrayType(RECOMMENDATION),
    causal_chain=TEXT,
    suggested_config=T.MapType(TEXT, TEXT),
)
RESULT = _struct(app_id=TEXT, rule_results=T.ArrayType(FINDING), ai_report=REPORT)

# Groups of per-task distributions kept for a stage, in record order.
TOP_QUANTILES = (
    "duration",
    "executor_deserialize_time",
    "executor_deserialize_cpu_time",
    "executor_run_time",
    "executor_cpu_time",
    "scheduler_delay",
    "getting_result_time",
    "result_serialization_time",
    "jvm_gc_time",
    "result_size",
    "peak_execution_memory",
    "memory_bytes_spilled",
    "disk_bytes_spilled",
)
GROUPED_QUANTILES = {
    "input_metrics": ("bytes", "records"),
    "output_metrics": ("bytes", "records"),
    "shuffle_read_metrics": (
        "read_bytes",
        "read_records",
        "remote_blocks_fetched",
        "local_blocks_fetched",
        "total_blocks_fetched",
        "fetch_wait_time",
        "remote_bytes_read",
        "remote_bytes_read_to_disk",
    ),
    "shuffle_write_metrics": ("write_bytes", "write_records", "write_time"),
}
QUANTILE_SLOTS = ("min", "p25", "median", "p75", "max")

# Totals of one stage, in the order of the stages table.
STAGE_TOTALS = (
    "task_count",
    "sum_run_ms",
    "gc_ms",
    "shuffle_read_bytes",
    "shuffle_write_bytes",
    "spill_disk_bytes",
    "spill_memory_bytes",
    "failed_tasks",
    "killed_tasks",
    "input_records",
    "output_records",
    "shuffle_read_records",
    "shuffle_write_records",
)
EXECUTOR_COLUMNS = (
    "ex_count",
    "ex_peak_mem",
    "ex_alloc_mem",
    "ex_task_ms",
    "ex_gc_ms",
    "ex_shuffle_read",
    "ex_shuffle_write",
    "ex_failed",
    "ex_cores",
)
