"""The same questions in DuckDB SQL, written against the given tables only."""

from __future__ import annotations

# ---------------------------------------------------------------- shared tables

TASKS = """
SELECT 'app_' || l_suppkey AS app_id, l_suppkey AS k, l_linenumber AS line, l_partkey % 8 AS stage_id,
  l_orderkey // 200000 AS log_no,
  10 * CAST(floor(pow(l_quantity, 1 + l_suppkey % 4)) AS BIGINT) AS run_ms,
  10 * CAST(floor(pow(l_quantity, 1 + l_suppkey % 4)) AS BIGINT) + 50 * l_linenumber AS duration_ms,
  CASE WHEN l_partkey % 8 > 2 AND l_suppkey % 7 = 0 THEN 0
       ELSE CAST(floor(pow(l_quantity, 1 + l_suppkey % 4) * 10 * l_discount * (l_partkey % 8) * 2) AS BIGINT) END AS gc_ms,
  CASE WHEN l_partkey % 8 >= 4 AND l_suppkey % 7 <> 0 THEN CAST(floor(l_extendedprice * 1000) AS BIGINT) ELSE 0 END AS shuffle_read_bytes,
  CASE WHEN l_partkey % 8 >= 4 AND l_suppkey % 7 <> 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS shuffle_read_records,
  CASE WHEN l_partkey % 8 > 2 AND l_suppkey % 7 = 0 THEN 0
       ELSE CAST(floor(l_extendedprice * 500 * (l_suppkey % 3)) AS BIGINT) END AS shuffle_write_bytes,
  CASE WHEN l_partkey % 8 > 2 AND l_suppkey % 7 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS shuffle_write_records,
  CASE WHEN l_partkey % 8 < 4
       THEN 10 * CAST(floor(l_extendedprice * l_quantity * (1 + l_suppkey % 5)) AS BIGINT) ELSE 0 END AS input_bytes,
  CASE WHEN l_partkey % 8 < 4 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS input_records,
  CAST(l_linenumber AS BIGINT) AS output_records,
  CASE WHEN l_partkey % 8 = 5 AND l_suppkey % 2 = 0 AND l_suppkey % 7 <> 0
       THEN CAST(floor(l_extendedprice * l_tax * 10000) AS BIGINT) ELSE 0 END AS spill_disk_bytes,
  (l_returnflag = 'R' AND l_linenumber = 1 AND l_suppkey % 3 = 0) AS failed,
  (l_returnflag = 'A' AND l_linenumber = 2 AND l_suppkey % 5 = 0) AS killed
FROM lineitem
"""


def _sums(*columns: str) -> str:
    return ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in columns)


def _quantiles(column: str, prefix: str) -> str:
    names = ("min", "p25", "median", "p75", "max")
    return ", ".join(
        f"trunc(quantile_cont({column}, {i / 4})) AS {prefix}_{name}" for i, name in enumerate(names)
    )


TOTAL_SUMS = (
    "gc_ms",
    "shuffle_read_bytes",
    "shuffle_write_bytes",
    "spill_disk_bytes",
    "input_records",
    "output_records",
    "shuffle_read_records",
    "shuffle_write_records",
)
ROLLUP_COLUMNS = f"""count(*) AS task_count, CAST(sum(run_ms) AS BIGINT) AS sum_run_ms, {_sums(*TOTAL_SUMS)},
  CAST(2 * sum(spill_disk_bytes) AS BIGINT) AS spill_memory_bytes,
  count(*) FILTER (failed) AS failed_tasks, count(*) FILTER (killed) AS killed_tasks"""
QUANTILE_COLUMNS = f"""{_quantiles('duration_ms', 'duration')}, {_quantiles('run_ms', 'run')},
  {_quantiles('gc_ms', 'gc')}, {_quantiles('input_bytes', 'input')}"""
TOTALS = f"SELECT app_id, stage_id, {ROLLUP_COLUMNS} FROM tasks GROUP BY ALL"
ROLLUP = f"SELECT app_id, stage_id, {ROLLUP_COLUMNS}, {QUANTILE_COLUMNS} FROM tasks GROUP BY ALL"

STAGE_RECORDS = """
SELECT app_id, stage_id, 'stage ' || (stage_id % 4) AS stage_name,
  CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(output_records) * 1000 AS BIGINT) AS output_bytes
FROM tasks WHERE NOT (stage_id = 7 AND k % 11 = 3) GROUP BY ALL
UNION ALL
SELECT 'app_' || s_suppkey, 8, 'stage 0', 0, 0 FROM supplier WHERE s_suppkey % 13 = 0
"""

STAGE_COLUMNS = (
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
QUANTILE_NAMES = [f"{m}_{q}" for m in ("duration", "run", "gc", "input") for q in ("min", "p25", "median", "p75", "max")]
STAGES = f"""
SELECT r.app_id, r.stage_id, r.stage_name, r.input_bytes, r.output_bytes,
  {', '.join(f'coalesce(u.{c}, 0) AS {c}' for c in STAGE_COLUMNS)},
  {', '.join(f'coalesce(u.{c}, 0.0::DOUBLE) AS {c}' for c in QUANTILE_NAMES)}
FROM stage_records r LEFT JOIN rollup u ON u.app_id = r.app_id AND u.stage_id = r.stage_id
"""

JOBS = """
SELECT 'app_' || k AS app_id, k, s_name AS app_name,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '2.4.8' WHEN 2 THEN '3.0.1' WHEN 3 THEN '3.4.1' ELSE '3.5.0' END AS spark_version,
  CASE k % 5 WHEN 1 THEN 2004 WHEN 2 THEN 3000 WHEN 3 THEN 3004 WHEN 4 THEN 3005 END AS version,
  200000 + 50000 * (k % 8) AS duration_ms,
  CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN 2000 ELSE 200 END AS shuffle_partitions,
  CASE k % 4 WHEN 1 THEN -1 WHEN 2 THEN 1048576 ELSE 10485760 END AS broadcast_threshold,
  k % 3 = 1 AS aqe_enabled, k % 3 <> 2 AS aqe_explicit,
  CASE WHEN k % 2 = 0 THEN 'org.apache.spark.serializer.KryoSerializer'
       ELSE 'org.apache.spark.serializer.JavaSerializer' END AS serializer,
  k % 5 IN (1, 4) AS dynamic_allocation,
  CASE WHEN k % 10 = 4 THEN '2' ELSE '' END AS min_executors,
  CASE WHEN k % 10 IN (4, 9) THEN '20' ELSE '' END AS max_executors,
  CASE WHEN k % 8 = 1 THEN '512m' ELSE '' END AS overhead,
  CASE k % 6 WHEN 0 THEN '256m' WHEN 1 THEN '1g' WHEN 2 THEN '20g' WHEN 4 THEN '4096' ELSE '4g' END AS driver_memory,
  CASE k % 6 WHEN 0 THEN 256 WHEN 1 THEN 1024 WHEN 2 THEN 20480 ELSE 4096 END AS driver_mb,
  CASE WHEN k % 2 = 0 THEN '4g' ELSE '1g' END AS executor_memory,
  CAST(CASE WHEN k % 9 = 8 THEN NULL WHEN k % 7 = 6 THEN 0 WHEN k % 7 = 5 THEN 60 ELSE 10 END AS BIGINT) AS ex_count,
  CASE WHEN k % 9 = 8 THEN NULL ELSE (k % 10 * 10 + 5) * 1048576 END AS ex_peak_mem,
  CASE WHEN k % 9 = 8 THEN NULL ELSE 104857600 END AS ex_alloc_mem,
  CASE WHEN k % 9 = 8 THEN NULL ELSE coalesce(task_ms, 0) END AS ex_task_ms,
  CASE WHEN k % 9 = 8 THEN NULL ELSE k % 3 END AS ex_failed,
  CAST(CASE WHEN k % 9 = 8 THEN NULL WHEN k % 2 = 1 OR k % 7 = 6 THEN 0 WHEN k % 7 = 5 THEN 240 ELSE 40 END AS BIGINT)
    AS ex_cores
FROM (SELECT s_suppkey AS k, s_name FROM supplier)
LEFT JOIN (SELECT k AS tk, CAST(sum(run_ms) AS BIGINT) AS task_ms FROM tasks GROUP BY 1) ON tk = k
"""

EVIDENCE = """
SELECT j.*,
  CASE WHEN ex_count <> 0 THEN ex_task_ms / (CAST(ex_count AS DOUBLE) * 4 * duration_ms) * 100 END AS slot_percent,
  ex_peak_mem / ex_alloc_mem * 100 AS memory_percent,
  e.max_shuffle_read, coalesce(e.reads_shuffle, false) AS reads_shuffle, coalesce(e.has_shuffle, false) AS has_shuffle,
  coalesce(e.has_spill, false) AS has_spill, e.hottest_gc, coalesce(e.gc_pressed, false) AS gc_pressed
FROM jobs j LEFT JOIN (
  SELECT app_id, max(shuffle_read_bytes) AS max_shuffle_read, bool_or(shuffle_read_bytes > 0) AS reads_shuffle,
    bool_or(shuffle_read_bytes > 0 OR shuffle_write_bytes > 0) AS has_shuffle, bool_or(spill_disk_bytes > 0) AS has_spill,
    max(CASE WHEN sum_run_ms = 0 THEN 0 ELSE gc_ms / sum_run_ms * 100 END) AS hottest_gc,
    bool_or(sum_run_ms >= 60000 AND gc_ms / sum_run_ms * 100 > 20) AS gc_pressed
  FROM stages GROUP BY 1) e USING (app_id)
"""

# ---------------------------------------------------------------- findings


def finding(rule: str, ord: int, source: str, when: str, severity: str, value: str, title: str, message: str,
            current: str = "''", recommended: str = "''", impact: str = "''", stage: str = "stage_id",
            columns: str = "*") -> str:
    """One rule as a SELECT; ``columns`` may add computed columns to the source."""
    return f"""
SELECT app_id, '{rule}' AS rule_id, severity, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END
  AS sev_order, {ord} AS rule_ord, {stage} AS stage_id, CAST({value} AS DOUBLE) AS value, {title} AS title,
  {message} AS message, {current} AS current_value, {recommended} AS recommended_value, {impact} AS estimated_impact
FROM (SELECT *, {severity} AS severity FROM (SELECT {columns} FROM {source}) WHERE {when})"""


def one(x: str) -> str:
    return f"printf('%.1f', CAST({x} AS DOUBLE))"


def none(x: str) -> str:
    return f"printf('%.0f', CAST({x} AS DOUBLE))"


def size_text(x: str) -> str:
    """Byte count in the largest unit below 1024."""
    d = f"CAST({x} AS DOUBLE)"
    cases = " ".join(
        f"WHEN abs({d}) < {1024 ** (i + 1)}::DOUBLE THEN printf('%.1f {unit}', {d} / {1024**i}::DOUBLE)"
        for i, unit in enumerate(("B", "KB", "MB", "GB", "TB"))
    )
    return f"(CASE {cases} ELSE printf('%.1f PB', {d} / {1024**5}::DOUBLE) END)"


SAVED = "CAST(trunc((1 - 1 / ratio) * 100) AS BIGINT)"
GB = "1073741824.0::DOUBLE"
IMPACT_AQE = "'AQE auto-handles partition coalescing, skew joins, and broadcast threshold'"
VOLUME_ADVICE = "'Use bucketing, pre-partition data, or reduce shuffle with broadcast joins'"
DRIVER = "'spark.driver.memory = ' || driver_memory"

RULES = {
    "data_skew": finding(
        "data_skew", 0,
        "(SELECT s.*, j.aqe_enabled FROM stages s JOIN jobs j USING (app_id))",
        "task_count >= 10 AND ratio >= 5",
        "CASE WHEN ratio > 10 THEN 'CRITICAL' ELSE 'WARNING' END",
        "ratio",
        "'Data skew in Stage ' || stage_id",
        f"'Max task duration (' || CAST(run_max AS BIGINT) || '.0ms) is ' || {one('ratio')} || 'x the median ('"
        " || CAST(run_median AS BIGINT) || '.0ms)'",
        f"'skew ratio ' || {one('ratio')} || 'x'",
        "CASE WHEN aqe_enabled THEN 'AQE is enabled but skew persists — consider salting the join key'"
        " ELSE 'Enable AQE: spark.sql.adaptive.enabled=true, spark.sql.adaptive.skewJoin.enabled=true' END",
        f"'Stage ' || stage_id || ' duration could decrease ~' || {SAVED} || '%'",
        columns="*, CASE WHEN run_median = 0 THEN 0 ELSE run_max / run_median END AS ratio",
    ),
    "spill_to_disk": finding(
        "spill_to_disk", 1, "stages", "spill_disk_bytes <> 0",
        "CASE WHEN input_bytes > 0 AND spill_disk_bytes / input_bytes < 0.01 THEN 'INFO' WHEN gb > 1 THEN 'CRITICAL'"
        " WHEN gb > 0.1 THEN 'WARNING' ELSE 'INFO' END",
        "gb",
        "'Disk spill in Stage ' || stage_id",
        f"{one('gb')} || ' GB spilled to disk — data doesn''t fit in memory'",
        f"{one('gb')} || ' GB spill'",
        "'Increase spark.executor.memory or spark.sql.shuffle.partitions'",
        "'Eliminating spill can speed up stage 2-10x'",
        columns=f"*, spill_disk_bytes / {GB} AS gb",
    ),
    "gc_pressure": finding(
        "gc_pressure", 2, "stages", "sum_run_ms >= 60000 AND gc >= 20",
        "CASE WHEN gc > 40 THEN 'CRITICAL' ELSE 'WARNING' END",
        "gc",
        "'High GC pressure in Stage ' || stage_id",
        f"'GC time is ' || {none('gc')} || '% of total task time'",
        f"{none('gc')} || '% GC time'",
        "'Increase executor memory or reduce data cached per task'",
        "'Reducing GC to <10% could save ~' || CAST(trunc(gc - 10) AS BIGINT) || '% stage time'",
        columns="*, CASE WHEN sum_run_ms = 0 THEN 0 ELSE gc_ms / sum_run_ms * 100 END AS gc",
    ),
    "shuffle_partitions": finding(
        "shuffle_partitions", 3, "evidence",
        "max_shuffle_read <> 0 AND NOT (aqe_enabled AND coalesce(version >= 3002, false)) AND (ratio < 0.5 OR ratio > 3)",
        "CASE WHEN ratio < 0.5 AND NOT aqe_enabled THEN 'WARNING' ELSE 'INFO' END",
        "ratio",
        "'Suboptimal shuffle partition count'",
        "CASE WHEN ratio < 0.5 THEN 'Too few partitions: ' ELSE 'Too many partitions: ' END || shuffle_partitions || ' for '"
        f" || {one(f'max_shuffle_read / {GB}')} || ' GB shuffle' || CASE WHEN ratio < 0.5 AND aqe_enabled THEN"
        " ' (AQE may handle partition coalescing automatically)' ELSE '' END",
        "'spark.sql.shuffle.partitions = ' || shuffle_partitions",
        "'spark.sql.shuffle.partitions = ' || optimal",
        "'Better partition sizing reduces spill and improves parallelism'",
        stage="CAST(NULL AS BIGINT)",
        columns="*, greatest(1, max_shuffle_read // 134217728) AS optimal,"
        " shuffle_partitions / greatest(1, max_shuffle_read // 134217728) AS ratio",
    ),
    "executor_idle": finding(
        "executor_idle", 4, "evidence", "duration_ms >= 300000 AND slot_percent <= 40",
        "CASE WHEN slot_percent < 20 AND NOT dynamic_allocation THEN 'CRITICAL'"
        " WHEN slot_percent < 20 OR NOT dynamic_allocation THEN 'WARNING' ELSE 'INFO' END",
        "slot_percent",
        "'Executor over-provisioning'",
        f"'Slot utilization is only ' || {none('slot_percent')} || '% — ' || {none('100 - slot_percent')} || '% idle'",
        f"ex_count || ' executors x 4 cores, ' || {none('slot_percent')} || '% utilized'",
        "'Reduce executor count or increase parallelism'",
        "'Right-sizing can reduce costs 30-50% (note: sequential stages reduce measured utilization)'",
        stage="CAST(NULL AS BIGINT)",
    ),
    "task_failures": finding(
        "task_failures", 5, "stages", "failed_tasks >= 1",
        "CASE WHEN failed_tasks >= 10 THEN 'CRITICAL' ELSE 'WARNING' END",
        "failed_tasks",
        "'Task failures in Stage ' || stage_id",
        "failed_tasks || ' of ' || task_count || ' tasks failed'",
        "failed_tasks || ' failed tasks'",
        "'Check executor logs for OOM or fetch failures'",
    ),
    "small_files": finding(
        "small_files", 6, "stages",
        "NOT (shuffle_read_bytes > 0 AND input_bytes = 0) AND per_task <> 0 AND per_task < 10485760",
        "CASE WHEN per_task < 1048576 THEN 'CRITICAL' ELSE 'WARNING' END",
        "per_task",
        "'Small input partitions in Stage ' || stage_id",
        f"'Input per task is ' || {one('per_task / 1048576')} || ' MB across ' || task_count || ' tasks'",
        f"{one('per_task / 1048576')} || ' MB/task, ' || task_count || ' tasks'",
        "'Use coalesce() or increase spark.sql.files.maxPartitionBytes'",
        "'Reducing task count cuts scheduler overhead and improves throughput'",
        columns="*, CASE WHEN input_median = 0 AND input_bytes > 0 AND task_count > 0 THEN input_bytes / task_count"
        " ELSE input_median END AS per_task",
    ),
    "broadcast_join": finding(
        "broadcast_join", 7, "evidence",
        "broadcast_threshold = -1 OR (reads_shuffle AND broadcast_threshold < 10485760)",
        "CASE WHEN broadcast_threshold = -1 AND reads_shuffle AND NOT aqe_enabled THEN 'WARNING' ELSE 'INFO' END",
        "broadcast_threshold",
        "CASE WHEN broadcast_threshold = -1 THEN 'Broadcast join disabled' ELSE 'Low broadcast join threshold' END",
        "CASE WHEN broadcast_threshold = -1 THEN 'spark.sql.autoBroadcastJoinThreshold is -1 (disabled)' ELSE"
        f" 'Threshold is ' || {none('broadcast_threshold / 1048576')} || ' MB — some shuffle joins might be avoidable' END",
        "CASE WHEN broadcast_threshold = -1 THEN 'disabled (-1)' ELSE"
        f" {none('broadcast_threshold / 1048576')} || ' MB' END",
        "CASE WHEN broadcast_threshold = -1 THEN 'spark.sql.autoBroadcastJoinThreshold = 10485760'"
        " ELSE 'spark.sql.autoBroadcastJoinThreshold = 10485760 (10 MB)' END",
        "CASE WHEN broadcast_threshold = -1 THEN 'Broadcasting small tables avoids expensive shuffle joins'"
        " ELSE 'Larger threshold may convert shuffle joins to broadcast joins' END",
        stage="CAST(NULL AS BIGINT)",
    ),
    "serializer_choice": finding(
        "serializer_choice", 8, "evidence", "NOT contains(serializer, 'KryoSerializer') AND has_shuffle",
        "'INFO'", "NULL",
        "'Using default Java serializer'",
        "'Current serializer: ' || serializer",
        "serializer",
        "'spark.serializer = org.apache.spark.serializer.KryoSerializer'",
        "'Kryo serialization is typically 10x faster and more compact'",
        stage="CAST(NULL AS BIGINT)",
    ),
    "dynamic_allocation": finding(
        "dynamic_allocation", 9, "evidence",
        "CASE WHEN dynamic_allocation THEN min_executors = '' OR max_executors = '' ELSE slot_percent < 40 END",
        "CASE WHEN dynamic_allocation THEN 'WARNING' ELSE 'INFO' END",
        "CASE WHEN dynamic_allocation THEN (min_executors = '')::INT + (max_executors = '')::INT ELSE slot_percent END",
        "CASE WHEN dynamic_allocation THEN 'Dynamic allocation without bounds'"
        " ELSE 'Consider enabling dynamic allocation' END",
        "CASE WHEN dynamic_allocation THEN 'Dynamic allocation enabled but ' || concat_ws(', ',"
        " CASE WHEN min_executors = '' THEN 'minExecutors' END, CASE WHEN max_executors = '' THEN 'maxExecutors' END)"
        f" || ' not set' ELSE 'Slot utilization is ' || {none('slot_percent')} || '% with fixed executor count' END",
        "CASE WHEN dynamic_allocation THEN 'spark.dynamicAllocation.enabled = true' ELSE ex_count ||"
        f" ' static executors, ' || {none('slot_percent')} || '% utilized' END",
        "CASE WHEN dynamic_allocation THEN concat_ws(', ', CASE WHEN min_executors = '' THEN"
        " 'spark.dynamicAllocation.minExecutors = <value>' END, CASE WHEN max_executors = '' THEN"
        " 'spark.dynamicAllocation.maxExecutors = <value>' END) ELSE 'spark.dynamicAllocation.enabled = true' END",
        "CASE WHEN dynamic_allocation THEN 'Unbounded dynamic allocation can over-provision resources'"
        " ELSE 'Dynamic allocation auto-scales executors to match workload' END",
        stage="CAST(NULL AS BIGINT)",
    ),
    "executor_memory_overhead": finding(
        "executor_memory_overhead", 10, "evidence", "hottest_gc > 20 AND memory_percent >= 80",
        "'WARNING'", "hottest_gc",
        "'Executor memory pressure detected'",
        f"'High GC (' || {none('hottest_gc')} || '% in hottest stage) with ' || {none('memory_percent')}"
        " || '% memory utilization'",
        "'memoryOverhead = ' || CASE WHEN overhead = '' THEN 'default (max(384MB, 10%))' ELSE overhead END",
        "'Increase spark.executor.memory to reduce heap GC pressure,"
        " or spark.executor.memoryOverhead if seeing container OOM kills'",
        "'Reducing memory pressure prevents GC thrashing and container OOM kills'",
        stage="CAST(NULL AS BIGINT)",
    ),
    "driver_memory": finding(
        "driver_memory", 11, "evidence",
        "driver_mb < 512 OR (coalesce(ex_count, 0) > 50 AND driver_mb < 2048) OR driver_mb > 16384",
        "CASE WHEN driver_mb < 2048 THEN 'WARNING' ELSE 'INFO' END",
        "driver_mb",
        "CASE WHEN driver_mb < 512 THEN 'Driver memory too low' WHEN driver_mb > 16384 THEN 'Driver memory too high'"
        " ELSE 'Driver memory insufficient for large cluster' END",
        "CASE WHEN driver_mb < 512 THEN 'Driver memory is too low: ' || driver_memory || ' (' || driver_mb ||"
        " ' MB) — risk of OOM' WHEN driver_mb > 16384 THEN 'Driver memory is too high: ' || driver_memory || ' (' ||"
        " driver_mb || ' MB) — resource waste' ELSE 'Driver memory ' || driver_memory ||"
        " ' may be insufficient for cluster with ' || ex_count || ' executors' END",
        DRIVER,
        "CASE WHEN driver_mb < 512 THEN 'spark.driver.memory >= 512m' WHEN driver_mb > 16384 THEN"
        " 'spark.driver.memory <= 16384m' ELSE 'spark.driver.memory >= 2048m' END",
        "CASE WHEN driver_mb < 512 THEN 'Insufficient driver memory causes OOM on collect/broadcast operations'"
        " WHEN driver_mb > 16384 THEN 'Over-provisioned driver wastes cluster resources'"
        " ELSE 'Large clusters need more driver memory for coordination and metadata' END",
        stage="CAST(NULL AS BIGINT)",
    ),
    "memory_underutilization": finding(
        "memory_underutilization", 12, "evidence",
        "ex_count IS NOT NULL AND NOT gc_pressed AND NOT has_spill AND memory_percent <> 0 AND memory_percent < 40",
        "'WARNING'", "memory_percent",
        "'Executor memory underutilized'",
        f"'Peak memory usage is only ' || {none('memory_percent')} || '% of allocated — executors overprovisioned'",
        f"{none('memory_percent')} || '% memory utilization'",
        "'Reduce spark.executor.memory to match actual usage + 20% buffer'",
        "'Right-sizing executor memory frees cluster resources'",
        stage="CAST(NULL AS BIGINT)",
    ),
    "aqe_not_enabled": finding(
        "aqe_not_enabled", 13, "evidence",
        "NOT aqe_enabled AND version >= 3000 AND (version < 3002 OR aqe_explicit)",
        "CASE WHEN version >= 3002 THEN 'WARNING' ELSE 'INFO' END",
        "version",
        "CASE WHEN version >= 3002 THEN 'AQE explicitly disabled' ELSE 'AQE not enabled' END",
        "CASE WHEN version >= 3002 THEN 'Adaptive Query Execution is disabled (enabled by default since Spark 3.2)'"
        " ELSE 'Consider enabling Adaptive Query Execution for automatic optimization' END",
        "'spark.sql.adaptive.enabled = false'",
        "'spark.sql.adaptive.enabled = true'",
        IMPACT_AQE,
        stage="CAST(NULL AS BIGINT)",
    ),
    "excessive_stages": finding(
        "excessive_stages", 14,
        "(SELECT app_id, list_sort(list(stage_name)) AS names FROM (SELECT app_id, stage_name FROM stages GROUP BY ALL"
        " HAVING count(*) > 1) GROUP BY 1)",
        "len(names) >= 2", "'WARNING'", "len(names)",
        "'Stages re-executed'",
        "'Stages re-executed: [''' || array_to_string(names, ''', ''') || '''] — add .persist() to avoid recomputation'",
        "len(names) || ' duplicate stage names'",
        "'Use .persist() or .cache() on reused DataFrames'",
        "'Shorter lineage reduces recomputation risk and planning overhead'",
        stage="CAST(NULL AS BIGINT)",
    ),
    "shuffle_data_volume": finding(
        "shuffle_data_volume", 15, "stages", "ratio > 3 OR gb > 50",
        "'WARNING'", "CASE WHEN ratio > 3 THEN ratio ELSE gb END",
        "'High shuffle volume in Stage ' || stage_id",
        f"'Stage writes ' || {one('gb')} || ' GB shuffle data' || CASE WHEN ratio > 3 THEN ' (' || {one('ratio')} ||"
        " 'x of input)' ELSE '' END || ' — consider pre-partitioning or bucketing'",
        f"{one('gb')} || ' GB shuffle write' || CASE WHEN ratio > 3 THEN ', ' || {one('ratio')} || 'x input ratio' ELSE '' END",
        VOLUME_ADVICE,
        "'Reduce disk I/O and network transfer'",
        columns=f"*, shuffle_write_bytes / {GB} AS gb,"
        " CASE WHEN input_bytes > 0 THEN shuffle_write_bytes / input_bytes END AS ratio",
    ),
    "input_data_skew": finding(
        "input_data_skew", 16, "stages",
        "task_count >= 10 AND NOT (shuffle_read_bytes > 0 AND input_bytes = 0) AND ratio >= 5",
        "CASE WHEN ratio >= 10 THEN 'CRITICAL' ELSE 'WARNING' END",
        "ratio",
        "'Input data skew in Stage ' || stage_id",
        f"'Max task input (' || {size_text('input_max')} || ') is ' || {one('ratio')} || 'x the median (' ||"
        f" {size_text('input_median')} || ')'",
        f"'input skew ratio ' || {one('ratio')} || 'x'",
        "'Repartition input data or use salting to distribute evenly'",
        f"'Stage ' || stage_id || ' tasks could run ~' || {SAVED} || '% faster'",
        columns="*, CASE WHEN input_median <> 0 THEN input_max / input_median END AS ratio",
    ),
}
FINDINGS = " UNION ALL ".join(RULES.values())

RUNS = """
SELECT CAST(event_id AS VARCHAR) AS task_id, event_id, 'app_' || (user_id % 100) AS app_id,
  ['static', 'ai', 'agent'][event_id % 3 + 1] AS mode,
  ['hs_manual', 'hs_poller', 'file', 'k8s', 'hdfs', 's3', 'gcs', 'storage'][event_id % 8 + 1] AS data_source,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END
    AS status,
  epoch_us(ts) AS created_us,
  CASE WHEN event_type <> 'signup' THEN epoch_us(ts) + 1000000 END AS started_us,
  CASE WHEN event_type NOT IN ('signup', 'view')
       THEN epoch_us(ts) + 1000000 + CAST(floor(value * 1000000) AS BIGINT) END AS completed_us,
  CASE WHEN event_type = 'error' THEN 'failed in ' || props END AS error,
  event_id % 3 <> 0 AS with_report
FROM events
"""
RESULTS = "SELECT r.task_id, f.* EXCLUDE (app_id) FROM runs r JOIN findings f USING (app_id) WHERE r.status = 'completed'"
# seven days before the fixed end of the window
SINCE = "epoch_us(TIMESTAMP '2024-01-24 00:00:00')"


def day(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%d')"


RECOMMENDATIONS = """
SELECT 'app_' || (p_partkey % 100) AS app_id, p_partkey AS pos, p_name AS title,
  CASE p_size % 5 WHEN 0 THEN 'spark.executor.memory' WHEN 1 THEN 'spark.sql.shuffle.partitions'
    WHEN 2 THEN 'spark.memory.fraction' WHEN 3 THEN '' ELSE 'spark.sql.autoBroadcastJoinThreshold' END AS parameter,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE 'c' || p_size END AS current_value,
  CASE WHEN p_size % 7 = 0 THEN '' ELSE p_size || 'g' END AS recommended_value, CAST(p_size % 5 AS BIGINT) AS priority,
  'because of ' || p_brand AS explanation, 'saves ' || p_size || '%' AS estimated_impact, p_type AS risk
FROM part
"""
SUGGESTED = """
SELECT app_id, parameter, arg_max(recommended_value, pos) AS recommended_value, min(pos) AS pos
FROM recommendations WHERE parameter LIKE 'spark.%' AND recommended_value <> '' GROUP BY ALL
"""
REPORTS = """
SELECT 'app_' || s_suppkey AS app_id, 'Summary of ' || s_name AS summary,
  CASE s_suppkey % 3 WHEN 0 THEN 'critical' ELSE 'Warning' END AS severity,
  'stage ' || (s_suppkey % 9) || ' waits' AS causal_chain FROM supplier
"""
CONFIG = """
SELECT app_id, k, key, value FROM (
  SELECT app_id, k, unnest([
    {'key': 'spark.executor.cores', 'value': '4'},
    {'key': 'spark.executor.memory', 'value': CASE WHEN k % 2 = 0 THEN '4g' END},
    {'key': 'spark.executor.memoryOverhead', 'value': nullif(overhead, '')},
    {'key': 'spark.driver.memory', 'value': driver_memory},
    {'key': 'spark.sql.adaptive.enabled', 'value': CASE k % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'True' END},
    {'key': 'spark.sql.shuffle.partitions', 'value': CASE WHEN k % 4 <> 3 THEN shuffle_partitions::VARCHAR END},
    {'key': 'spark.sql.autoBroadcastJoinThreshold',
     'value': CASE WHEN k % 4 IN (1, 2) THEN broadcast_threshold::VARCHAR END},
    {'key': 'spark.serializer', 'value': CASE WHEN k % 2 = 0 THEN serializer END},
    {'key': 'spark.dynamicAllocation.enabled',
     'value': CASE k % 5 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 4 THEN 'true' END},
    {'key': 'spark.dynamicAllocation.minExecutors', 'value': nullif(min_executors, '')},
    {'key': 'spark.dynamicAllocation.maxExecutors', 'value': nullif(max_executors, '')},
    {'key': 'spark.memory.fraction', 'value': CASE WHEN k % 3 = 1 THEN '0.6' END},
    {'key': 'spark.app.tag', 'value': 't' || k}], recursive := true) FROM jobs)
WHERE value IS NOT NULL
"""

# event logs: every log holds the tasks of one application and one range of orders
LOG_TASKS = "SELECT *, app_id || '_' || log_no AS log_id FROM tasks"
LOGS = "SELECT log_id, k, app_id, count(*) AS n FROM log_tasks GROUP BY ALL"
KEPT_TASKS = "SELECT * FROM log_tasks WHERE line <> 7"
LOG_STAGES = """
SELECT log_id, k, stage_id, 'stage ' || (stage_id % 4) AS stage_name,
  1700000000000 + k * 1000 AS submission_ms, 1700000000000 + k * 1000 + 1000 * (stage_id + 1) AS completion_ms,
  CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(output_records) * 1000 AS BIGINT) AS output_bytes
FROM log_tasks WHERE NOT (stage_id = 7 AND k % 11 = 3) GROUP BY ALL
"""
LOG_ROLLUP = f"SELECT log_id, stage_id, {ROLLUP_COLUMNS}, {QUANTILE_COLUMNS} FROM kept_tasks GROUP BY ALL"
LOG_DURATION = """
SELECT l.*, CASE WHEN k % 4 <> 3 THEN 200000 + 50000 * (k % 8)
  ELSE coalesce((SELECT max(completion_ms) - (1700000000000 + l.k * 1000) FROM log_stages s WHERE s.log_id = l.log_id), 0)
  END AS duration_ms FROM logs l
"""

# saved payloads
ATTEMPTS = f"""
SELECT app_id, stage_id, CAST(line % 2 AS BIGINT) AS attempt, count(*) AS task_count,
  {_sums('run_ms', 'gc_ms', 'shuffle_read_bytes', 'shuffle_write_bytes', 'spill_disk_bytes', 'input_bytes')},
  count(*) FILTER (failed) AS failed,
  quantile_cont(run_ms, [0, 0.25, 0.5, 0.75, 1]) AS run_q, quantile_cont(input_bytes, [0, 0.25, 0.5, 0.75, 1]) AS input_q
FROM tasks GROUP BY ALL
"""
LATEST_STAGES = """
SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY app_id, stage_id ORDER BY attempt DESC) = 1
"""
APPLICATIONS = """
SELECT 'app_' || s_suppkey AS id, s_name AS name, s_suppkey AS k, s_suppkey % 4 AS attempts FROM supplier
"""

CTES = {
    "tasks": (TASKS, ()),
    "totals": (TOTALS, ("tasks",)),
    "rollup": (ROLLUP, ("tasks",)),
    "stage_records": (STAGE_RECORDS, ("tasks",)),
    "stages": (STAGES, ("rollup", "stage_records")),
    "jobs": (JOBS, ("tasks",)),
    "evidence": (EVIDENCE, ("jobs", "stages")),
    "findings": (FINDINGS, ("evidence",)),
    "runs": (RUNS, ()),
    "results": (RESULTS, ("runs", "findings")),
    "recommendations": (RECOMMENDATIONS, ()),
    "suggested": (SUGGESTED, ("recommendations",)),
    "reports": (REPORTS, ()),
    "config": (CONFIG, ("jobs",)),
    "log_tasks": (LOG_TASKS, ("tasks",)),
    "logs": (LOGS, ("log_tasks",)),
    "kept_tasks": (KEPT_TASKS, ("log_tasks",)),
    "log_stages": (LOG_STAGES, ("log_tasks",)),
    "log_rollup": (LOG_ROLLUP, ("kept_tasks",)),
    "log_duration": (LOG_DURATION, ("logs", "log_stages")),
    "attempts": (ATTEMPTS, ("tasks",)),
    "latest_stages": (LATEST_STAGES, ("attempts",)),
    "applications": (APPLICATIONS, ()),
}


def ask(select: str, *needs: str) -> str:
    """``select`` preceded by the shared tables it needs."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for dependency in CTES[name][1]:
            add(dependency)
        if name not in wanted:
            wanted.append(name)

    for name in needs:
        add(name)
    ctes = ", ".join(f"{name} AS ({CTES[name][0].strip()})" for name in wanted)
    return f"WITH {ctes} {select}" if ctes else select
