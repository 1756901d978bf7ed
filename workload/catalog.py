"""Every operator as a query over the given tables, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions import config as C
from fleetgauge.functions import scalars as X
from fleetgauge.functions.explain import DESCRIPTIONS, assess_metric, explain_metric
from fleetgauge.functions.text import array_of, format_bytes, literal
from fleetgauge.operators import daily, dedup, events, findings, history_server, metrics, run_history, run_state
from fleetgauge.plans.analyze import Fleet, analyze_jobs, fold_history
from fleetgauge.plans.rules import BUILT_IN, evaluate_rules
from fleetgauge.schemas import EXECUTOR_COLUMNS, STAGE_TOTALS
from fleetgauge.sources import codec_ranges, event_logs, runs as run_source
from fleetgauge.sources.run_tables import read_documents
from fleetgauge.sources.staging import new_path, stage_table
from fleetgauge.streaming import logs as log_stream
from fleetgauge.streaming import retries as log_retries
from fleetgauge.streaming import status as status_stream
from workload import adapters as A
from workload import oracles as O
from workload.oracles import SINCE, STAGE_COLUMNS, ask, day, size_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

QUANTILE_FIELDS = ("min", "p25", "median", "p75", "max")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def _flat(struct: str, prefix: str) -> list[str]:
    return [f"{struct}.{q} AS {prefix}_{q}" for q in QUANTILE_FIELDS]


def _prefixed(prefix: str) -> str:
    return ", ".join(f"{prefix}_{q}" for q in QUANTILE_FIELDS)


# ------------------------------------------------------------ sources and sinks

LOG_ID = "regexp_extract(log_path, 'log_id=([^/]+)/', 1) AS log_id"


@query(
    "scan_event_log",
    # seven header lines, executors, tasks, stage records, the end
    ask(
        """SELECT log_id, CAST(7 + k % 7 + n + (k % 4 <> 3)::INT + (SELECT count(*) + count(*) FILTER (stage_id % 2 = 0)
        FROM log_stages s WHERE s.log_id = l.log_id) AS BIGINT) AS lines FROM logs l""",
        "logs",
        "log_stages",
    ),
)
def scan_event_log(spark: SparkSession, sf: str) -> DataFrame:
    scans = (event_logs.scan_event_log(spark, folder) for folder, _ in A.log_folders(spark, sf))
    return A.staged_rounds(spark, "scanned", (_lines_per_log(lines) for lines in scans))


def _lines_per_log(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(LOG_ID).groupBy("log_id").agg(F.count("*").alias("lines"))


def _compressed_logs(lines: DataFrame) -> DataFrame:
    """Log contents as LZ4 frames and raw Snappy blocks; a log is dealt to many files to keep each small."""
    dealt = lines.selectExpr("*", "pmod(xxhash64(value), 16) AS piece")
    # lines meet in order, file after file, so that no task holds more than the lines of a batch
    placed = dealt.repartition("log_id", "piece").sortWithinPartitions("log_id", "piece", "phase", "ord", "value")
    suffix = "if(piece % 2 = 0, 'lz4', 'snappy')"
    named = placed.selectExpr(f"concat('/logs/log_id=', log_id, '/', piece, '.', {suffix}) AS path", "value")
    return named.mapInArrow(_compress, "path string, content binary")


def _compress(batches):
    """Files of ``path, value`` lines; those of one path stand together, also across batches."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def encoded(path, data):
        if path.endswith("snappy"):
            return pa.compress(data, codec="snappy", asbytes=True)
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as stream:
            stream.write(data)
        return sink.getvalue().to_pybytes()

    def files(paths, contents):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    current, parts = None, []
    for batch in batches:
        runs = pc.run_end_encode(batch.column(0))
        lists = pa.ListArray.from_arrays(pa.array([0, *runs.run_ends.to_pylist()], pa.int32()), batch.column(1))
        paths, contents = [], []
        for path, text in zip(runs.values.to_pylist(), pc.binary_join(lists, "\n").to_pylist()):
            if parts and path != current:
                paths.append(current)
                contents.append(encoded(current, b"\n".join(parts)))
                parts = []
            current = path
            parts.append(text.encode())
        yield files(paths, contents)
    if parts:
        yield files([current], [encoded(current, b"\n".join(parts))])


@query("scan_event_log_codec", ORACLES["scan_event_log"])
def scan_event_log_codec(spark: SparkSession, sf: str) -> DataFrame:
    scans = (event_logs.decode_logs(_compressed_logs(lines)) for lines in A.line_rounds(spark, sf))
    return A.staged_rounds(spark, "decoded", (_lines_per_log(lines) for lines in scans))


@query(
    "scan_codec_ranges",
    ask(
        """SELECT log_id, CAST(7 + k % 7 + n + (k % 4 <> 3)::INT + (SELECT count(*) + count(*) FILTER (stage_id % 2 = 0)
        FROM log_stages s WHERE s.log_id = l.log_id) AS BIGINT) AS lines, TRUE AS as_written FROM logs l""",
        "logs",
        "log_stages",
    ),
)
def scan_codec_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Real compressed files read in ranges much smaller than they are; ``as_written``: the lines' hashes add up to those written."""
    hashed = "sum(cast(xxhash64(value) AS decimal(38,0)))"

    def compared(folder: str, lines: DataFrame) -> DataFrame:
        read = codec_ranges.scan_codec_ranges(spark, folder, range_bytes=16_384).selectExpr(LOG_ID, "value")
        read = read.groupBy("log_id").agg(F.count("*").alias("lines"), F.expr(f"{hashed} AS hashed"))
        written = lines.groupBy("log_id").agg(F.expr(f"{hashed} AS written"))
        return read.join(written, "log_id", "full").selectExpr("log_id", "lines", "hashed <=> written AS as_written")

    return A.staged_rounds(spark, "ranges", (compared(*of_round) for of_round in A.codec_log_folders(spark, sf)))


@query("list_event_logs", ask("SELECT log_id, 1::BIGINT AS files, 1::BIGINT AS filled FROM logs", "logs"))
def list_event_logs(spark: SparkSession, sf: str) -> DataFrame:
    def counted(folder: str) -> DataFrame:
        files = event_logs.list_event_logs(spark, folder).filter("name LIKE 'part-%'")
        return files.selectExpr("path AS log_path", "size").selectExpr(LOG_ID, "size").groupBy("log_id").agg(
            F.count("*").alias("files"), F.count_if(F.col("size") > 0).alias("filled")
        )

    return A.staged_rounds(spark, "listed", (counted(folder) for folder, _ in A.log_folders(spark, sf)))


@query(
    "scan_history_json",
    ask(
        """SELECT id AS app_id, kind, CASE kind WHEN 'executors' THEN 4 WHEN 'stages' THEN
        (SELECT count(*) FROM attempts a WHERE a.app_id = id) WHEN 'taskSummary' THEN
        (SELECT count(*) FROM attempts a WHERE a.app_id = id AND stage_id <> 1) ELSE 1 END AS payload_rows
        FROM applications, (VALUES ('applications'), ('environment'), ('stages'), ('taskSummary'), ('executors')) t(kind)
        WHERE payload_rows > 0""",
        "applications",
        "attempts",
    ),
)
def scan_history_json(spark: SparkSession, sf: str) -> DataFrame:
    return _payload_rows(A.payloads(spark, sf))


@query("scan_history_json_arrays", ORACLES["scan_history_json"])
def scan_history_json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return _payload_rows(A.array_payloads(spark, sf))


@query(
    "payload_order",
    ask(
        """SELECT app_id, count(*) AS stages, true AS in_order FROM attempts GROUP BY 1""",
        "attempts",
    ),
)
def payload_order(spark: SparkSession, sf: str) -> DataFrame:
    """Stages keep the order of their payload: here they were written by stage and attempt."""
    written = "struct(stageId, coalesce(attemptId, 0L))"
    before = f"lag({written}) OVER (PARTITION BY app_id ORDER BY pos)"
    stages = A.array_payloads(spark, sf).stages.selectExpr("app_id", f"coalesce({before} <= {written}, true) AS follows")
    return stages.groupBy("app_id").agg(F.count("*").alias("stages"), F.bool_and("follows").alias("in_order"))


def _payload_rows(payloads) -> DataFrame:
    kinds = {
        "applications": payloads.applications,
        "environment": payloads.environments,
        "stages": payloads.stages,
        "taskSummary": payloads.summaries,
        "executors": payloads.executors,
    }
    counts = None
    for kind, df in kinds.items():
        part = df.groupBy("app_id").agg(F.count("*").alias("payload_rows")).withColumn("kind", F.lit(kind))
        counts = part if counts is None else counts.unionByName(part)
    return counts


RUN_SQL = """task_id, app_id, mode, data_source, status, created_us, started_us, completed_us, error"""
RUN_EXPRS = (
    *("task_id", "app_id", "mode", "data_source", "status"),
    "unix_micros(created_at) AS created_us",
    "unix_micros(started_at) AS started_us",
    "unix_micros(completed_at) AS completed_us",
    "error",
)


@query(
    "scan_runs",
    ask(
        f"""SELECT {RUN_SQL}, status = 'completed' AS has_result, status = 'completed' AND with_report AS has_report
        FROM runs""",
        "runs",
    ),
)
def scan_runs(spark: SparkSession, sf: str) -> DataFrame:
    return A.stored_run_rows(spark, sf).selectExpr(*RUN_EXPRS, "has_result", "has_report")


@query(
    "scan_runs_documents",
    ask(
        """SELECT r.task_id, bool_and(status = 'completed' AND r.task_id NOT LIKE '%3') AS has_result,
        bool_and(status = 'completed' AND with_report AND r.task_id NOT LIKE '%3') AS has_report,
        count(f.rule_id) FILTER (r.task_id NOT LIKE '%3') AS findings,
        count(f.rule_id) FILTER (r.task_id NOT LIKE '%3' AND f.severity = 'CRITICAL') AS critical
        FROM runs r LEFT JOIN results f ON f.task_id = r.task_id GROUP BY r.task_id""",
        "runs",
        "results",
    ),
)
def scan_runs_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Runs read from their documents alone: every tenth cut in half, every tenth with a field of a later version."""
    given = A.stored_runs(spark, sf).drop("rule_results", "has_report")
    document = """CASE WHEN task_id LIKE '%3' THEN left(result_json, length(result_json) DIV 2)
        WHEN task_id LIKE '%5' THEN concat('{"version": 9, ', substr(result_json, 2)) ELSE result_json END"""
    decoded = run_source.decode_runs(given.withColumn("result_json", F.expr(document)))
    per_run = decoded.selectExpr(
        "task_id",
        "rule_results IS NOT NULL AS has_result",
        "has_report",
        "coalesce(size(rule_results), 0) AS n",
        "coalesce(size(filter(rule_results, f -> f.severity = 'CRITICAL')), 0) AS n_critical",
    )
    return per_run.groupBy("task_id").agg(
        F.bool_or("has_result").alias("has_result"),
        F.bool_or("has_report").alias("has_report"),
        F.sum("n").alias("findings"),
        F.sum("n_critical").alias("critical"),
    )


@query(
    "sink_results",
    ask("SELECT task_id, rule_id, severity, stage_id, title, recommended_value FROM results", "results"),
)
def sink_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.stored_result_rows(spark, sf)
    return rows.select("task_id", "rule_id", "severity", "stage_id", "title", "recommended_value")


@query(
    "sink_properties",
    ask("SELECT app_id, parameter || ' = ' || recommended_value AS line FROM suggested", "suggested"),
)
def sink_properties(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "properties")
    run_source.sink_properties(findings.suggested_entries(A.part_recommendations(spark, sf)), path)
    return spark.read.schema("value string, app_id string").text(path).selectExpr("app_id", "value AS line")


# ------------------------------------------------------------ event projection and folds


def _parsed(spark: SparkSession, sf: str) -> Iterator[DataFrame]:
    """Parsed events of all logs, round by round."""
    for folder, _ in A.log_folders(spark, sf):
        yield events.parse_events(event_logs.scan_event_log(spark, folder))


@A.shared_plan
def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed events, written once and read back by every fold."""
    kept = (events.filter_event_types(parsed) for parsed in _parsed(spark, sf))
    return A.staged_rounds(spark, "events", kept, "has_task_parts")


EVENT_COUNTS = """
SELECT log_id, unnest(['LogStart', 'ApplicationStart', 'EnvironmentUpdate', 'ExecutorAdded', 'TaskEnd', 'StageCompleted',
  'ApplicationEnd']) AS kind, unnest([1, 1, 2, k % 7, n, (SELECT count(*) + count(*) FILTER (stage_id % 2 = 0)
  FROM log_stages s WHERE s.log_id = l.log_id), (k % 4 <> 3)::BIGINT]) AS events FROM logs l"""


@query("parse_events", ask(f"SELECT * FROM ({EVENT_COUNTS}) WHERE events > 0", "logs", "log_stages"))
def parse_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = "replace(Event, 'SparkListener', '') AS kind"

    def counted(parsed: DataFrame) -> DataFrame:
        return parsed.selectExpr(LOG_ID, kind).groupBy("log_id", "kind").agg(F.count("*").alias("events"))

    return A.staged_rounds(spark, "event-counts", (counted(parsed) for parsed in _parsed(spark, sf)))


@query(
    "filter_event_types",
    ask(
        f"""SELECT 'SparkListener' || kind AS Event, CAST(sum(events) AS BIGINT) AS events FROM ({EVENT_COUNTS})
        GROUP BY 1""",
        "logs",
        "log_stages",
    ),
)
def filter_event_types(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy("Event").agg(F.count("*").alias("events"))


@query(
    "app_facts",
    ask(
        """SELECT log_id AS app_id, 'job ' || k AS app_name, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '2.4.8'
        WHEN 2 THEN '3.0.1' WHEN 3 THEN '3.4.1' ELSE '3.5.0' END AS spark_version, 1700000000000 + k * 1000 AS start_ms,
        CASE WHEN k % 4 <> 3 THEN 1700000000000 + k * 1000 + 200000 + 50000 * (k % 8) ELSE 0 END AS end_ms FROM logs""",
        "logs",
    ),
)
def app_facts(spark: SparkSession, sf: str) -> DataFrame:
    return events.app_facts(_events(spark, sf)).select("app_id", "app_name", "spark_version", "start_ms", "end_ms")


@query(
    "config_fold",
    ask(
        """SELECT l.log_id, c.key, CASE WHEN c.key = 'spark.app.tag' THEN 'late' ELSE c.value END AS value
        FROM logs l JOIN config c USING (app_id) UNION ALL SELECT log_id, 'spark.extra', log_id FROM logs""",
        "logs",
        "config",
    ),
)
def config_fold(spark: SparkSession, sf: str) -> DataFrame:
    return events.config_fold(_events(spark, sf)).selectExpr(LOG_ID, "explode(config) AS (key, value)")


@query(
    "stage_facts",
    ask("SELECT log_id, stage_id, stage_name, submission_ms, completion_ms FROM log_stages", "log_stages"),
)
def stage_facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = events.stage_facts(_events(spark, sf))
    return facts.selectExpr(LOG_ID, "stage_id", "stage_name", "submission_ms", "completion_ms")


@query("stage_accumulator", ask("SELECT log_id, stage_id, input_bytes, output_bytes FROM log_stages", "log_stages"))
def stage_accumulator(spark: SparkSession, sf: str) -> DataFrame:
    return events.stage_facts(_events(spark, sf)).selectExpr(LOG_ID, "stage_id", "input_bytes", "output_bytes")


@query("task_facts", ask("SELECT log_id, stage_id, count(*) AS tasks FROM kept_tasks GROUP BY ALL", "kept_tasks"))
def task_facts(spark: SparkSession, sf: str) -> DataFrame:
    tasks = events.task_facts(_events(spark, sf)).selectExpr(LOG_ID, "stage_id")
    return tasks.groupBy("log_id", "stage_id").agg(F.count("*").alias("tasks"))


TASK_COLUMNS = (
    "duration_ms",
    "run_ms",
    "gc_ms",
    "shuffle_read_bytes",
    "shuffle_read_records",
    "shuffle_write_bytes",
    "shuffle_write_records",
    "input_records",
    "output_records",
    "spill_disk_bytes",
    "spill_memory_bytes",
    "failed",
    "killed",
)


@query(
    "task_measures",
    ask(
        f"""SELECT log_id, stage_id, {', '.join(c for c in TASK_COLUMNS if c != 'spill_memory_bytes')},
        2 * spill_disk_bytes AS spill_memory_bytes FROM kept_tasks""",
        "kept_tasks",
    ),
)
def task_measures(spark: SparkSession, sf: str) -> DataFrame:
    return events.task_facts(_events(spark, sf)).selectExpr(LOG_ID, "stage_id", *TASK_COLUMNS)


@query("executor_count", ask("SELECT log_id, k % 7 AS executor_count FROM logs", "logs"))
def executor_count(spark: SparkSession, sf: str) -> DataFrame:
    return events.app_facts(_events(spark, sf)).selectExpr(LOG_ID, "executor_count")


@query("resolve_duration", ask("SELECT log_id, duration_ms FROM log_duration", "log_duration"))
def resolve_duration(spark: SparkSession, sf: str) -> DataFrame:
    log_events = _events(spark, sf)
    facts = events.resolve_duration(events.app_facts(log_events), events.stage_facts(log_events))
    return facts.selectExpr(LOG_ID, "duration_ms")


# ------------------------------------------------------------ stage and job metrics


@query("stage_totals", ask("SELECT * FROM totals", "totals"))
def stage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stage_totals(A.lineitem_tasks(spark, sf))


@query(
    "stage_quantiles",
    ask(f"SELECT app_id, stage_id, {_prefixed('duration')}, {_prefixed('run')}, {_prefixed('gc')} FROM rollup", "rollup"),
)
def stage_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    wide = metrics.stage_quantiles(A.lineitem_tasks(spark, sf))
    return _named_quantiles(wide)


def _named_quantiles(wide: DataFrame) -> DataFrame:
    return wide.selectExpr(
        "app_id",
        "stage_id",
        *_flat("duration", "duration"),
        *_flat("executor_run_time", "run"),
        *_flat("jvm_gc_time", "gc"),
    )


@query("stage_quantiles_hot", ORACLES["stage_quantiles"])
def stage_quantiles_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Same answer with value ranges so wide, as those of a stage of billions of tasks, that most ranks need the second read."""
    return _named_quantiles(metrics.stage_quantiles(A.lineitem_tasks(spark, sf), digits=1))


LOG_STAGE_SQL = f"""SELECT s.log_id, s.stage_id, s.stage_name, s.input_bytes, s.output_bytes,
  {', '.join(f'coalesce(u.{c}, 0) AS {c}' for c in STAGE_COLUMNS)},
  {', '.join(f'coalesce(u.run_{q}, 0.0::DOUBLE) AS run_{q}' for q in QUANTILE_FIELDS)},
  {', '.join(f'coalesce(u.duration_{q}, 0.0::DOUBLE) AS duration_{q}' for q in QUANTILE_FIELDS)}
  FROM log_stages s LEFT JOIN log_rollup u ON u.log_id = s.log_id AND u.stage_id = s.stage_id"""
LOG_STAGE_EXPRS = (
    LOG_ID,
    "stage_id",
    "stage_name",
    "input_bytes",
    "output_bytes",
    *STAGE_TOTALS,
    *_flat("dist.executor_run_time", "run"),
    *_flat("dist.duration", "duration"),
)


@A.shared_plan
def _log_stages(spark: SparkSession, sf: str) -> DataFrame:
    log_events = _events(spark, sf)
    return metrics.stage_metrics(events.stage_facts(log_events), events.task_facts(log_events), "log_path")


@query("stage_metrics", ask(LOG_STAGE_SQL, "log_stages", "log_rollup"))
def stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _log_stages(spark, sf).selectExpr(*LOG_STAGE_EXPRS)


@query(
    "job_metrics",
    ask(
        """SELECT l.log_id, l.log_id AS app_id, 'job ' || l.k AS app_name, l.duration_ms, l.k % 7 AS ex_count,
        0::BIGINT AS ex_alloc_mem, coalesce(t.ms, 0) AS ex_task_ms,
        (SELECT count(*) + 1 FROM config c WHERE c.app_id = l.app_id) AS properties FROM log_duration l LEFT JOIN
        (SELECT log_id, CAST(sum(run_ms) AS BIGINT) AS ms FROM kept_tasks GROUP BY 1) t USING (log_id)""",
        "log_duration",
        "kept_tasks",
        "config",
    ),
)
def job_metrics(spark: SparkSession, sf: str) -> DataFrame:
    log_events = _events(spark, sf)
    facts = events.resolve_duration(events.app_facts(log_events), events.stage_facts(log_events))
    totals = metrics.stage_totals(events.task_facts(log_events), "log_path")
    jobs = metrics.job_metrics(facts, events.config_fold(log_events), totals)
    return jobs.selectExpr(
        LOG_ID,
        "app_id",
        "app_name",
        "duration_ms",
        "ex_count",
        "ex_alloc_mem",
        "ex_task_ms",
        "bigint(size(config)) AS properties",
    )


def _rounded(x: str, digits: int) -> str:
    """Correct rounding in DuckDB."""
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


SUM_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {n}" for n, c in metrics.OVERVIEW_SUMS.items())
BYTE_SUMS = [n for n, c in metrics.OVERVIEW_SUMS.items() if c.endswith("_bytes")]


@query(
    "job_overview",
    ask(
        f"""SELECT j.app_id, app_name, spark_version, duration_ms, {_rounded('duration_ms / 60000', 1)} AS duration_min,
        coalesce(stage_count, 0) AS stage_count, {', '.join(f'coalesce(s.{n}, 0) AS {n}' for n in metrics.OVERVIEW_SUMS)},
        CASE WHEN coalesce(total_run_ms, 0) = 0 THEN 0 ELSE total_gc_ms / total_run_ms END * 100 AS gc_percent,
        {', '.join(f"{size_text(f'coalesce(s.{n}, 0)')} AS {n}_text" for n in BYTE_SUMS)},
        ex_count AS executor_count, ex_cores AS executor_cores, ex_failed AS executor_failed_tasks,
        {_rounded('ex_peak_mem / ex_alloc_mem * 100', 1)} AS memory_utilization_percent,
        {_rounded('slot_percent', 1)} AS slot_utilization_percent, CAST(shuffle_partitions AS BIGINT) AS shuffle_partitions,
        executor_memory, 4::BIGINT AS cores_per_executor
        FROM evidence j LEFT JOIN (SELECT app_id, count(*) AS stage_count, {SUM_SQL} FROM stages GROUP BY 1) s USING (app_id)""",
        "evidence",
        "stages",
    ),
)
def job_overview(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.job_overview(A.fleet_stages(spark, sf), A.fleet_jobs(spark, sf))


SKEW_SQL = "CASE WHEN run_median = 0 THEN 0 ELSE run_max / run_median END"
GC_SQL = "CASE WHEN sum_run_ms = 0 THEN 0 ELSE gc_ms / sum_run_ms END * 100"


@query(
    "stage_summary",
    ask(
        f"""SELECT app_id, stage_id, stage_name AS name, task_count AS tasks, {_rounded(GC_SQL, 1)} AS gc_percent,
        spill_disk_bytes > 0 AS has_spill, shuffle_read_bytes > 0 OR shuffle_write_bytes > 0 AS has_shuffle,
        {_rounded(SKEW_SQL, 1)} AS skew_ratio, failed_tasks FROM stages""",
        "stages",
    ),
)
def stage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stage_summary(A.fleet_stages(spark, sf))


@query(
    "stage_detail",
    ask(
        f"""SELECT app_id, stage_id, stage_name, input_bytes, output_bytes, {', '.join(STAGE_COLUMNS)},
        {_prefixed('run')}, {_prefixed('gc')}, {_prefixed('input')} FROM stages WHERE stage_id = 5""",
        "stages",
    ),
)
def stage_detail(spark: SparkSession, sf: str) -> DataFrame:
    detail = metrics.stage_detail(A.fleet_stages(spark, sf), 5)
    return detail.selectExpr(
        *("app_id", "stage_id", "stage_name", "input_bytes", "output_bytes"),
        *STAGE_TOTALS,
        *_flat("dist.executor_run_time", "run"),
        *_flat("dist.jvm_gc_time", "gc"),
        *_flat("dist.input_metrics.bytes", "input"),
    )


@A.shared_plan
def _payload_stages(spark: SparkSession, sf: str) -> DataFrame:
    return A.stage_payloads(spark, sf).stages


@query(
    "hs_dedup_stages",
    ask(
        """SELECT app_id, stage_id AS "stageId", CASE WHEN attempt > 0 THEN attempt END AS "attemptId",
        task_count AS "numTasks", row_number() OVER (PARTITION BY app_id ORDER BY
        (SELECT min(attempt) FROM attempts a WHERE a.app_id = l.app_id AND a.stage_id = l.stage_id), stage_id DESC) AS place
        FROM latest_stages l""",
        "latest_stages",
    ),
)
def hs_dedup_stages(spark: SparkSession, sf: str) -> DataFrame:
    kept = history_server.hs_dedup_stages(_payload_stages(spark, sf))
    place = "bigint(row_number() OVER (PARTITION BY app_id ORDER BY pos)) AS place"
    return kept.selectExpr("app_id", "stageId", "attemptId", "numTasks", place)


HS_RUN = """CASE WHEN stage_id = 1 THEN 0.0::DOUBLE WHEN stage_id = 2 THEN run_q[least({0}, 3)] ELSE run_q[{0}] END"""
HS_RUN_SQL = ", ".join(f"{HS_RUN.format(i + 1)} AS run_{q}" for i, q in enumerate(QUANTILE_FIELDS))
HS_CPU_SQL = ", ".join(
    f"CASE WHEN stage_id = 1 THEN 0.0::DOUBLE ELSE run_q[{i + 1}] * 1000 / 1000000 END AS cpu_{q}"
    for i, q in enumerate(QUANTILE_FIELDS)
)
HS_INPUT_SQL = ", ".join(
    f"CASE WHEN stage_id = 1 THEN 0.0::DOUBLE ELSE input_q[{i + 1}] END AS input_{q}"
    for i, q in enumerate(QUANTILE_FIELDS)
)


@A.shared_plan
def _payload_fleet_stages(spark: SparkSession, sf: str) -> DataFrame:
    return fold_history(A.stage_payloads(spark, sf)).stages


@query(
    "hs_stage_metrics",
    ask(
        """SELECT app_id, stage_id, CASE WHEN stage_id = 6 THEN 'Stage 6' ELSE 'stage ' || (stage_id % 4) END AS stage_name,
        task_count, run_ms AS sum_run_ms, gc_ms, shuffle_read_bytes, shuffle_write_bytes, spill_disk_bytes,
        0::BIGINT AS spill_memory_bytes, failed AS failed_tasks, input_bytes FROM latest_stages""",
        "latest_stages",
    ),
)
def hs_stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _payload_fleet_stages(spark, sf).select(
        *("app_id", "stage_id", "stage_name", "task_count", "sum_run_ms", "gc_ms", "shuffle_read_bytes"),
        *("shuffle_write_bytes", "spill_disk_bytes", "spill_memory_bytes", "failed_tasks", "input_bytes"),
    )


@query(
    "hs_quantiles",
    ask(f"SELECT app_id, stage_id, {HS_RUN_SQL}, {HS_CPU_SQL}, {HS_INPUT_SQL} FROM latest_stages", "latest_stages"),
)
def hs_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return _payload_fleet_stages(spark, sf).selectExpr(
        "app_id",
        "stage_id",
        *_flat("dist.executor_run_time", "run"),
        *_flat("dist.executor_cpu_time", "cpu"),
        *_flat("dist.input_metrics.bytes", "input"),
    )


HS_EXECUTOR_SQL = """3::BIGINT AS ex_count, CASE WHEN k % 2 = 0 THEN k * 150 + 6 ELSE 0 END AS ex_peak_mem,
  k * 300 + 6 AS ex_alloc_mem, k * 30 + 6 AS ex_task_ms, k * 3 + 6 AS ex_gc_ms, k * 9 + 6 AS ex_shuffle_read,
  k * 6 + 6 AS ex_shuffle_write, k % 4 * 3 + 6 AS ex_failed, 12::BIGINT AS ex_cores"""


@query("hs_executors", ask(f"SELECT id AS app_id, {HS_EXECUTOR_SQL} FROM applications", "applications"))
def hs_executors(spark: SparkSession, sf: str) -> DataFrame:
    payloads = A.job_payloads(spark, sf)
    return history_server.hs_executors(payloads.executors)


@query(
    "hs_environment",
    ask(
        "SELECT app_id, key, CASE WHEN key = 'spark.app.tag' THEN 'late ' || app_id ELSE value END AS value FROM config",
        "config",
    ),
)
def hs_environment(spark: SparkSession, sf: str) -> DataFrame:
    payloads = A.job_payloads(spark, sf)
    return history_server.hs_environment(payloads.environments).selectExpr("app_id", "explode(config) AS (key, value)")


@query(
    "hs_job",
    ask(
        f"""SELECT id AS app_id, name AS app_name,
        CASE WHEN attempts > 0 THEN '3.' || attempts || '.' || (k % 3) ELSE '' END AS spark_version,
        CASE WHEN attempts > 0 THEN k * 1000 + attempts ELSE 0 END AS duration_ms,
        '/applications/' || id || CASE WHEN attempts > 0 AND k % 5 <> 0 THEN '/' || attempts ELSE '' END AS base_path,
        (SELECT count(*) FROM config c WHERE c.app_id = id) AS properties, {HS_EXECUTOR_SQL} FROM applications""",
        "applications",
        "config",
    ),
)
def hs_job(spark: SparkSession, sf: str) -> DataFrame:
    payloads = A.job_payloads(spark, sf)
    jobs = fold_history(payloads).jobs
    paths = payloads.applications.selectExpr("id AS app_id", f"{history_server.base_path()} AS base_path")
    return jobs.join(paths, "app_id").selectExpr(
        *("app_id", "app_name", "spark_version", "duration_ms", "base_path", "bigint(size(config)) AS properties"),
        *EXECUTOR_COLUMNS,
    )


# ------------------------------------------------------------ derived columns


def _stage_columns(name: str, sql: str, needs: str, *exprs: str) -> None:
    @query(name, ask(f"SELECT app_id, stage_id, {sql} FROM {needs}", needs))
    def derived(spark: SparkSession, sf: str) -> DataFrame:
        return A.fleet_stages(spark, sf).selectExpr("app_id", "stage_id", *exprs)


def _job_columns(name: str, sql: str, needs: str, *exprs: str) -> None:
    @query(name, ask(f"SELECT app_id, {sql} FROM {needs}", needs))
    def derived(spark: SparkSession, sf: str) -> DataFrame:
        return A.fleet_jobs(spark, sf).selectExpr("app_id", *exprs)


RUN, READ = "dist.executor_run_time", "dist.input_metrics.bytes"
_stage_columns(
    "skew_ratio",
    f"{SKEW_SQL} AS run_skew, CASE WHEN input_median = 0 THEN 0 ELSE input_max / input_median END AS input_skew",
    "stages",
    f"{X.skew_ratio(RUN)} AS run_skew",
    f"{X.skew_ratio(READ)} AS input_skew",
)
_stage_columns(
    "iqr",
    "greatest(0, run_p75 - run_p25) AS run_iqr, greatest(0, input_p75 - input_p25) AS input_iqr",
    "stages",
    f"{X.iqr(RUN)} AS run_iqr",
    f"{X.iqr(READ)} AS input_iqr",
)
_stage_columns("gc_time_percent", f"{GC_SQL} AS gc", "stages", f"{X.gc_time_percent('gc_ms', 'sum_run_ms')} AS gc")
_job_columns(
    "memory_utilization",
    "ex_peak_mem / ex_alloc_mem * 100 AS memory_percent",
    "jobs",
    f"{X.memory_utilization('ex_peak_mem', 'ex_alloc_mem')} AS memory_percent",
)
CORES = C.config_accessors()["executor_cores"]
_job_columns(
    "slot_utilization",
    "slot_percent",
    "evidence",
    f"{X.slot_utilization('ex_task_ms', 'ex_count', CORES, 'duration_ms')} AS slot_percent",
)
_job_columns(
    "slot_utilization_total_cores",
    """CASE WHEN ex_count <> 0 AND ex_task_ms > 0 THEN ex_task_ms / (CAST(CASE WHEN ex_cores > 0 THEN ex_cores
    ELSE 4 * ex_count END AS DOUBLE) * duration_ms) * 100 END AS slot_percent""",
    "jobs",
    f"{X.slot_utilization_total_cores('ex_task_ms', 'ex_count', CORES, 'ex_cores', 'duration_ms')} AS slot_percent",
)


@query(
    "config_accessors",
    ask(
        """SELECT app_id, executor_memory, 4::BIGINT AS executor_cores, CAST(shuffle_partitions AS BIGINT) AS
        shuffle_partitions, dynamic_allocation, aqe_enabled, aqe_explicit, serializer, CAST(broadcast_threshold AS BIGINT)
        AS broadcast_threshold, min_executors, max_executors, overhead AS executor_memory_overhead, driver_memory,
        '' AS driver_memory_overhead FROM jobs""",
        "jobs",
    ),
)
def config_accessors(spark: SparkSession, sf: str) -> DataFrame:
    return C.typed_config(A.fleet_jobs(spark, sf))


# memory texts of every shape, derived from the part table
MEMORY_UNITS = ("", "m", "G", "k", "t", " gb", "MB", "x", "b")


@query(
    "parse_memory_mb",
    """SELECT p_partkey, text, CAST(trunc(CASE p_partkey % 9 WHEN 2 THEN p_size * 1024 + 512 WHEN 3 THEN
    greatest(1, p_size // 1024) WHEN 4 THEN p_size * 1048576 WHEN 5 THEN p_size * 1024 + 512 WHEN 7 THEN 0 ELSE p_size END)
    AS BIGINT) AS mb FROM (SELECT *, p_size || CASE WHEN p_partkey % 9 IN (2, 5) THEN '.5' ELSE '' END ||
    ['', 'm', 'G', 'k', 't', ' gb', 'MB', 'x', 'b'][p_partkey % 9 + 1] AS text FROM part)""",
)
def parse_memory_mb(spark: SparkSession, sf: str) -> DataFrame:
    unit = A.pick("p_partkey % 9", *MEMORY_UNITS)
    texts = A.table(spark, sf, "part").selectExpr(
        "p_partkey", f"concat(p_size, if(p_partkey % 9 IN (2, 5), '.5', ''), {unit}) AS text"
    )
    return texts.selectExpr("p_partkey", "text", f"{X.parse_memory_mb('text')} AS mb")




@query(
    "format_bytes",
    f"""SELECT n, count(*) AS rows, {size_text('n')} AS text FROM (SELECT CAST(floor(l_extendedprice *
    [1, 100, 10000, 1000000, 100000000, 10000000000, 1000000000000][l_linenumber]) AS BIGINT) AS n FROM lineitem)
    GROUP BY 1""",
)
def format_bytes_query(spark: SparkSession, sf: str) -> DataFrame:
    factor = "array(1L, 100L, 10000L, 1000000L, 100000000L, 10000000000L, 1000000000000L)[int(l_linenumber) - 1]"
    sizes = A.table(spark, sf, "lineitem").selectExpr(f"bigint(floor(l_extendedprice * {factor})) AS n")
    counted = sizes.groupBy("n").agg(F.count("*").alias("rows"))
    return counted.selectExpr("n", "rows", f"{format_bytes('n')} AS text")


_job_columns(
    "parse_spark_version",
    "spark_version, CAST(version AS INTEGER) AS version",
    "jobs",
    "spark_version",
    f"{X.parse_spark_version('spark_version')} AS version",
)

METRIC_ROWS = (
    ("gc_time_percent", X.gc_time_percent("gc_ms", "sum_run_ms"), GC_SQL),
    ("spill_to_disk_bytes", "double(spill_disk_bytes)", "spill_disk_bytes::DOUBLE"),
    ("data_skew_ratio", X.skew_ratio(RUN), SKEW_SQL),
    ("memory_utilization_percent", "double(task_count)", "task_count::DOUBLE"),
    ("input_bytes", "double(input_bytes)", "input_bytes::DOUBLE"),
    ("task_count", "double(task_count)", "task_count::DOUBLE"),
    ("no such metric", "double(stage_id)", "stage_id::DOUBLE"),
)


@A.shared_plan
def _metric_values(spark: SparkSession, sf: str) -> DataFrame:
    pairs = array_of(f"named_struct('metric_name', {literal(n)}, 'value', {expr})" for n, expr, _ in METRIC_ROWS)
    return A.fleet_stages(spark, sf).selectExpr("app_id", "stage_id", f"inline({pairs})")


METRIC_SQL = " UNION ALL ".join(
    f"SELECT app_id, stage_id, '{n}' AS metric_name, CAST({sql} AS DOUBLE) AS value FROM stages" for n, _, sql in METRIC_ROWS
)
ASSESS_SQL = """CASE
  WHEN critical IS NULL THEN '' WHEN value >= critical THEN '**Critical** — value exceeds the critical threshold (' || c || ')'
  WHEN value >= warning THEN '**Warning** — value exceeds the warning threshold (' || w || ')'
  ELSE '**Healthy** — value is within normal range' END"""
LIMITS_SQL = """(VALUES ('gc_time_percent', 20.0::DOUBLE, 40.0::DOUBLE, '20', '40'),
  ('spill_to_disk_bytes', 0.1::DOUBLE * 1073741824, 1073741824.0::DOUBLE, '1.07374e+08', '1.07374e+09'),
  ('data_skew_ratio', 5.0, 10.0, '5', '10'), ('memory_utilization_percent', 80.0, 95.0, '80', '95'))
  l(metric_name, warning, critical, w, c)"""


@query(
    "assess_metric",
    ask(
        f"""SELECT app_id, stage_id, metric_name, value, {ASSESS_SQL} AS assessment FROM ({METRIC_SQL})
        LEFT JOIN {LIMITS_SQL} USING (metric_name)""",
        "stages",
    ),
)
def assess_metric_query(spark: SparkSession, sf: str) -> DataFrame:
    return _metric_values(spark, sf).selectExpr("*", f"{assess_metric('metric_name', 'value')} AS assessment")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DESCRIPTION_SQL = "(VALUES " + ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in DESCRIPTIONS.items()) + ")"
KNOWN_SQL = _sql_text("`. Known metrics: " + ", ".join(f"`{n}`" for n in sorted(DESCRIPTIONS)))


@query(
    "explain_metric",
    ask(
        f"""SELECT app_id, stage_id, metric_name, value, formatted_value, assessment, description IS NOT NULL AS known,
        CASE WHEN description IS NULL THEN 'Unknown metric: `' || metric_name || {KNOWN_SQL} ELSE
        '## Metric: `' || metric_name || '`' || chr(10) || chr(10) || '**Value:** ' || formatted_value || chr(10) || chr(10)
        || description || CASE WHEN assessment = '' THEN '' ELSE chr(10) || chr(10) || '### Assessment' || chr(10) || chr(10)
        || assessment END END AS explanation FROM (
        SELECT *, {ASSESS_SQL} AS assessment, CASE WHEN contains(metric_name, 'bytes') THEN {size_text('value')}
        ELSE format('{{:,.2f}}', value) END AS formatted_value FROM ({METRIC_SQL})
        LEFT JOIN {LIMITS_SQL} USING (metric_name)
        LEFT JOIN {DESCRIPTION_SQL} d(metric_name, description) USING (metric_name))""",
        "stages",
    ),
)
def explain_metric_query(spark: SparkSession, sf: str) -> DataFrame:
    return explain_metric(_metric_values(spark, sf)).drop("description")


CATEGORY_SQL = " ".join(
    f"WHEN {' OR '.join(f'starts_with(key, {_sql_text(p)})' for p in prefixes)} THEN {{{i}}}"
    for i, (_, prefixes) in enumerate(C.CATEGORIES)
)


@query(
    "config_category",
    ask(
        f"""SELECT app_id, key, value,
        CASE {CATEGORY_SQL.format(*range(len(C.CATEGORIES)))} ELSE {len(C.CATEGORIES)} END AS category_rank,
        CASE {CATEGORY_SQL.format(*[_sql_text(n) for n, _ in C.CATEGORIES])} ELSE 'Other' END AS category FROM config""",
        "config",
    ),
)
def config_category(spark: SparkSession, sf: str) -> DataFrame:
    return C.config_category(A.fleet_jobs(spark, sf))


@query(
    "config_snapshot",
    ask(
        f"SELECT app_id, key, value FROM config WHERE key IN ({', '.join(map(_sql_text, C.SNAPSHOT_KEYS))}) AND value <> ''",
        "config",
    ),
)
def config_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return C.config_snapshot(A.fleet_jobs(spark, sf))


@query(
    "stage_flags",
    ask(
        f"""SELECT app_id, stage_id, concat_ws(', ', CASE WHEN skew > 5 THEN 'SKEW(' || printf('%.1f', skew) || 'x)' END,
        CASE WHEN spill_disk_bytes > 0 THEN 'SPILL' END, CASE WHEN gc > 20 THEN 'GC(' || printf('%.0f', gc) || '%)' END,
        CASE WHEN failed_tasks >= 1 THEN 'FAILURES(' || failed_tasks || ')' END,
        CASE WHEN killed_tasks > 0 THEN 'KILLED(' || killed_tasks || ')' END) AS flags
        FROM (SELECT *, CAST({SKEW_SQL} AS DOUBLE) AS skew, CAST({GC_SQL} AS DOUBLE) AS gc FROM stages)""",
        "stages",
    ),
)
def stage_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = metrics.stage_flags(A.fleet_stages(spark, sf))
    return flags.selectExpr("app_id", "stage_id", "array_join(flags, ', ') AS flags")


@query(
    "optimal_partitions",
    ask(
        f"""SELECT app_id, total, text, optimal, {_rounded('total / (optimal * 1048576.0::DOUBLE)', 1)} AS partition_mb
        FROM (SELECT app_id, total, {size_text('total')} AS text, CASE WHEN total > 0 THEN
        greatest(1, CAST(ceil(total / 134217728.0::DOUBLE) AS BIGINT)) ELSE 1 END AS optimal FROM
        (SELECT app_id, CAST(sum(shuffle_read_bytes) AS BIGINT) AS total FROM stages GROUP BY 1))""",
        "stages",
    ),
)
def optimal_partitions(spark: SparkSession, sf: str) -> DataFrame:
    totals = A.fleet_stages(spark, sf).groupBy("app_id").agg(F.sum("shuffle_read_bytes").alias("total"))
    sized = totals.selectExpr("*", f"{format_bytes('total')} AS text", f"{X.optimal_partitions('total', 128)} AS optimal")
    return sized.selectExpr("*", f"{X.partition_size_mb('total', 'optimal')} AS partition_mb")


# ------------------------------------------------------------ rules

FINDING_SQL = """app_id, rule_id, severity, sev_order, rule_ord, stage_id, value, title, message, current_value,
  recommended_value, estimated_impact"""


def _rule_query(rule_id: str) -> None:
    sql = O.RULES[rule_id]
    needs = ("evidence",) if not BUILT_IN[rule_id].per_stage else ("stages", "jobs")

    @query(f"rule_{rule_id}", ask(f"SELECT {FINDING_SQL} FROM ({sql})", *needs))
    def one_rule(spark: SparkSession, sf: str) -> DataFrame:
        found = evaluate_rules(A.fleet_stages(spark, sf), A.fleet_jobs(spark, sf), A.THRESHOLDS, [rule_id])
        return found.drop("stage_pos")


for _rule in BUILT_IN:
    _rule_query(_rule)


@query("run_rules", ask(f"SELECT {FINDING_SQL} FROM findings", "findings"))
def run_rules(spark: SparkSession, sf: str) -> DataFrame:
    return A.fleet_findings(spark, sf).drop("stage_pos")


@query(
    "analyze_jobs",
    ask(
        """SELECT j.app_id, app_name, spark_version, duration_ms, rule_id, severity, stage_id, value, title, message
        FROM jobs j LEFT JOIN findings f USING (app_id)""",
        "jobs",
        "findings",
    ),
)
def analyze(spark: SparkSession, sf: str) -> DataFrame:
    fleet = Fleet(A.fleet_stages(spark, sf), A.fleet_jobs(spark, sf), "app_id")
    return analyze_jobs(fleet, A.THRESHOLDS).select(
        *("app_id", "app_name", "spark_version", "duration_ms", "rule_id", "severity", "stage_id", "value", "title", "message")
    )


# ------------------------------------------------------------ findings and recommendations


@query(
    "severity_counts",
    ask(
        """SELECT task_id, critical, warning, info, CASE WHEN c.task_id IS NOT NULL THEN concat_ws(',',
        CASE WHEN critical > 0 THEN 'CRITICAL=' || critical END, CASE WHEN warning > 0 THEN 'WARNING=' || warning END,
        CASE WHEN info > 0 THEN 'INFO=' || info END) END AS severity_counts FROM runs LEFT JOIN (
          SELECT task_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS
          warning, count(*) FILTER (severity = 'INFO') AS info FROM results GROUP BY 1) c USING (task_id)""",
        "runs",
        "results",
    ),
)
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = findings.severity_counts(A.event_results(spark, sf), runs=A.event_runs(spark, sf))
    entries = "transform(map_entries(severity_counts), e -> concat(e.key, '=', e.value))"
    return counted.withColumn("severity_counts", F.expr(f"array_join({entries}, ',')"))


@query(
    "run_findings",
    ask("SELECT task_id, rule_id, severity, stage_id, title, message FROM results", "results"),
)
def run_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = findings.run_findings(A.event_runs(spark, sf), A.event_results(spark, sf))
    return found.select("task_id", "rule_id", "severity", "stage_id", "title", "message")


@query(
    "stage_issue_groups",
    ask(
        """SELECT app_id, stage_id, count(*) AS issues, CASE min(sev_order) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING'
        ELSE 'INFO' END AS worst_severity, string_agg(rule_id, ',' ORDER BY sev_order, rule_ord) AS rules,
        (SELECT count(DISTINCT stage_id) FROM findings g WHERE g.app_id = f.app_id) AS stages
        FROM findings f WHERE stage_id IS NOT NULL GROUP BY app_id, stage_id""",
        "findings",
    ),
)
def stage_issue_groups(spark: SparkSession, sf: str) -> DataFrame:
    found = A.fleet_findings(spark, sf)
    groups = findings.stage_issue_groups(found).join(findings.stages_with_issues(found), "app_id")
    return groups.selectExpr(
        *("app_id", "stage_id", "issues", "worst_severity", "array_join(rule_ids, ',') AS rules", "stages")
    )


@query(
    "suggest_config",
    ask(
        """SELECT app_id, rule_id, stage_id, current_value, recommended_value FROM findings
        WHERE recommended_value <> '' AND current_value <> ''""",
        "findings",
    ),
)
def suggest_config(spark: SparkSession, sf: str) -> DataFrame:
    return findings.suggest_config(A.fleet_findings(spark, sf))


COMPARISON_SQL = """
SELECT app_id, parameter, CASE source WHEN 1 THEN coalesce(rule_current, '') ELSE current_value END AS current_value,
  recommended_value, CASE source WHEN 0 THEN 'rule' ELSE 'ai' END AS source
FROM (SELECT *, max_by(CASE WHEN source = 0 THEN current_value END, place) FILTER (source = 0)
        OVER (PARTITION BY app_id, parameter) AS rule_current,
      row_number() OVER (PARTITION BY app_id, parameter ORDER BY place DESC) AS newest
  FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY source, p0, p1, p2) AS place FROM (
    SELECT app_id, CASE WHEN contains(current_value, '=') THEN trim(split_part(current_value, '=', 1)) ELSE rule_id END
      AS parameter, 0 AS source, sev_order AS p0, rule_ord AS p1, coalesce(stage_id, -1) AS p2, current_value,
      recommended_value FROM findings WHERE recommended_value <> ''
    UNION ALL SELECT app_id, parameter, 1, pos, 0, 0, NULL, recommended_value FROM suggested
    UNION ALL SELECT app_id, parameter, 2, pos, 0, 0, current_value, recommended_value FROM recommendations
      WHERE parameter <> '')))
WHERE newest = 1"""


@query("config_comparison", ask(COMPARISON_SQL, "findings", "suggested"))
def config_comparison(spark: SparkSession, sf: str) -> DataFrame:
    advice = A.part_recommendations(spark, sf)
    compared = findings.config_comparison(A.fleet_findings(spark, sf), findings.suggested_entries(advice), advice)
    return compared.drop("first_at")


@query("suggested_config", ask("SELECT app_id, parameter, recommended_value FROM suggested", "suggested"))
def suggested_config(spark: SparkSession, sf: str) -> DataFrame:
    maps = findings.suggested_config(A.part_recommendations(spark, sf))
    return maps.selectExpr("app_id", "explode(suggested_config) AS (parameter, recommended_value)")


@query(
    "build_report",
    ask(
        """SELECT app_id, 'summary' AS section, 0 AS sev_order, 0 AS rule_ord, 0::BIGINT AS pos, NULL::BIGINT AS stage_id,
        NULL::BIGINT AS priority, upper(severity) AS severity, summary AS title, '' AS message, '' AS parameter,
        '' AS current_value, '' AS recommended_value, '' AS explanation, '' AS estimated_impact, '' AS risk, causal_chain
        FROM reports UNION ALL
        SELECT app_id, 'finding', sev_order, rule_ord, coalesce(stage_id, -1), stage_id, NULL, severity, title, message, rule_id, current_value,
        recommended_value, '', estimated_impact, '', '' FROM findings SEMI JOIN reports USING (app_id) UNION ALL
        SELECT app_id, 'recommendation', 0, 0, pos, NULL, priority, '', title, '', parameter, current_value, recommended_value,
        explanation, estimated_impact, risk, '' FROM recommendations SEMI JOIN reports USING (app_id) UNION ALL
        SELECT app_id, 'property', 0, 0, pos, NULL, NULL, '', '', '', parameter, '', recommended_value, '', '', '', ''
        FROM suggested SEMI JOIN reports USING (app_id)""",
        "findings",
        "suggested",
        "reports",
    ),
)
def build_report(spark: SparkSession, sf: str) -> DataFrame:
    return findings.build_report(
        A.supplier_reports(spark, sf), A.fleet_findings(spark, sf), A.part_recommendations(spark, sf)
    )


@query(
    "config_diff",
    ask(
        """SELECT s.app_id, parameter, coalesce(nullif(c.value, ''), '(not set)') AS current_value,
        recommended_value AS proposed_value, coalesce(c.value, '') <> recommended_value AS changed,
        count(*) OVER (PARTITION BY s.app_id) AS total_changes FROM suggested s SEMI JOIN jobs USING (app_id)
        LEFT JOIN config c ON c.app_id = s.app_id AND c.key = s.parameter""",
        "suggested",
        "config",
    ),
)
def config_diff(spark: SparkSession, sf: str) -> DataFrame:
    proposed = findings.suggested_entries(A.part_recommendations(spark, sf)).selectExpr(
        "app_id", "parameter", "recommended_value AS proposed_value"
    )
    return findings.config_diff(proposed, A.fleet_jobs(spark, sf))


COMPARE_LABELS = ("Duration", "Total Tasks", "Shuffle Read", "Shuffle Write", "Spill to Disk", "Memory Utilization", "Executors")


@query(
    "compare_jobs",
    ask(
        f"""WITH sides AS (SELECT app_id, k, ex_count, [duration_ms::DOUBLE, coalesce(tasks, 0)::DOUBLE,
          coalesce(sr, 0)::DOUBLE, coalesce(sw, 0)::DOUBLE, coalesce(sp, 0)::DOUBLE, ex_peak_mem / ex_alloc_mem * 100,
          ex_count::DOUBLE] AS v FROM jobs LEFT JOIN (SELECT app_id, sum(task_count) AS tasks,
          sum(shuffle_read_bytes) AS sr, sum(shuffle_write_bytes) AS sw, sum(spill_disk_bytes) AS sp FROM stages GROUP BY 1)
          USING (app_id)),
        pairs AS (SELECT a.app_id AS app_a, b.app_id AS app_b, unnest(range(7)) AS position, a.v AS va, b.v AS vb,
          a.ex_count IS NOT NULL AND b.ex_count IS NOT NULL AS comparable FROM sides a JOIN sides b ON b.k = a.k + 1)
        SELECT *, CASE WHEN position IN (2, 3, 4) THEN CASE WHEN delta = 0 THEN '0 B' ELSE CASE WHEN delta > 0 THEN '+' ELSE '-' END
            || {size_text('abs(delta)')} END
          WHEN position = 0 THEN CASE WHEN delta >= 0 THEN '+' ELSE '-' END || printf('%.1f', abs(delta / 1000)) || 's'
          WHEN position = 5 THEN CASE WHEN delta >= 0 THEN '+' ELSE '' END || printf('%.1f', delta) || '%'
          ELSE CASE WHEN delta >= 0 THEN '+' ELSE '' END || printf('%.0f', delta) END AS delta_text,
          coalesce(CASE WHEN change_percent >= 0 THEN '+' ELSE '' END || printf('%.1f', change_percent) || '%', 'N/A') AS change_text
        FROM (SELECT app_a, app_b, CAST(position AS INTEGER) AS position, {list(COMPARE_LABELS)}[position + 1] AS metric,
          va[position + 1] AS value_a, vb[position + 1] AS value_b, vb[position + 1] - va[position + 1] AS delta,
          CASE WHEN va[position + 1] <> 0 THEN (vb[position + 1] - va[position + 1]) / va[position + 1] * 100 END
          AS change_percent FROM pairs WHERE comparable OR position < 5)""",
        "jobs",
        "stages",
    ).replace(" WITH sides AS", ", sides AS", 1),
)
def compare_jobs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = A.table(spark, sf, "supplier").selectExpr(
        "concat('app_', s_suppkey) AS app_a", "concat('app_', s_suppkey + 1) AS app_b"
    )
    return findings.compare_jobs(A.fleet_stages(spark, sf), A.fleet_jobs(spark, sf), pairs)


# ------------------------------------------------------------ run history


def _as_run(df: DataFrame) -> DataFrame:
    return df.selectExpr(*RUN_EXPRS)


@query(
    "list_runs",
    ask(
        f"""SELECT {RUN_SQL}, (SELECT count(*) FROM runs WHERE status = 'completed') AS total FROM runs
        WHERE status = 'completed' ORDER BY created_us DESC, task_id DESC LIMIT 50 OFFSET 20""",
        "runs",
    ),
)
def list_runs(spark: SparkSession, sf: str) -> DataFrame:
    page = run_history.list_runs(A.event_runs(spark, sf), limit=50, offset=20, status="completed")
    return page.selectExpr(*RUN_EXPRS, "total")


@query(
    "latest_run_per_app",
    ask(
        f"""SELECT {RUN_SQL} FROM runs QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY created_us DESC, task_id DESC)
        = 1""",
        "runs",
    ),
)
def latest_run_per_app(spark: SparkSession, sf: str) -> DataFrame:
    return _as_run(run_history.latest_run_per_app(A.event_runs(spark, sf)))


@query(
    "count_by_app_ids",
    ask(
        """SELECT app_id, count(*) AS analysis_count FROM runs WHERE app_id IN (SELECT id FROM applications
        WHERE k % 2 = 0) GROUP BY 1""",
        "runs",
        "applications",
    ),
)
def count_by_app_ids(spark: SparkSession, sf: str) -> DataFrame:
    wanted = A.supplier_applications(spark, sf).filter("k % 2 = 0").selectExpr("id AS app_id")
    return run_history.count_by_app_ids(A.event_runs(spark, sf), wanted)


@query(
    "count_by_status",
    ask(
        f"""SELECT 'all' AS scope, status, count(*) AS count, (SELECT count(*) FROM runs) AS total FROM runs GROUP BY ALL
        UNION ALL SELECT 'window', status, count(*), (SELECT count(*) FROM runs WHERE created_us >= {SINCE})
        FROM runs WHERE created_us >= {SINCE} GROUP BY ALL""",
        "runs",
    ),
)
def count_by_status(spark: SparkSession, sf: str) -> DataFrame:
    runs = A.event_runs(spark, sf)
    every = run_history.count_by_status(runs).withColumn("scope", F.lit("all"))
    recent = run_history.count_by_status(runs, run_history.since(A.AS_OF, A.DAYS)).withColumn("scope", F.lit("window"))
    return every.unionByName(recent)


@query(
    "runs_since",
    ask(
        f"""SELECT 'created' AS form, {RUN_SQL} FROM runs WHERE created_us >= {SINCE} UNION ALL
        SELECT 'completed', {RUN_SQL} FROM runs WHERE status = 'completed' AND completed_us >= {SINCE}""",
        "runs",
    ),
)
def runs_since(spark: SparkSession, sf: str) -> DataFrame:
    runs = A.event_runs(spark, sf)
    created = run_history.runs_since(runs, A.AS_OF, A.DAYS).selectExpr("'created' AS form", *RUN_EXPRS)
    completed = run_history.runs_since(runs, A.AS_OF, A.DAYS, completed=True)
    return created.unionByName(completed.selectExpr("'completed' AS form", *RUN_EXPRS))


def _breakdown(name: str, key: str, sql_key: str, operator) -> None:
    @query(
        name,
        ask(f"SELECT {sql_key} AS {key}, count(*) AS count FROM runs WHERE created_us >= {SINCE} GROUP BY 1", "runs"),
    )
    def breakdown(spark: SparkSession, sf: str) -> DataFrame:
        return operator(A.event_runs(spark, sf), A.AS_OF, A.DAYS)


_breakdown("daily_volume", "day", day("created_us"), run_history.daily_volume)
_breakdown("mode_breakdown", "mode", "mode", run_history.mode_breakdown)
_breakdown("source_breakdown", "data_source", "data_source", run_history.source_breakdown)


@query(
    "top_apps",
    ask(
        f"""SELECT app_id, count(*) AS analysis_count FROM runs WHERE created_us >= {SINCE} GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 10""",
        "runs",
    ),
)
def top_apps(spark: SparkSession, sf: str) -> DataFrame:
    return run_history.top_apps(A.event_runs(spark, sf), A.AS_OF, A.DAYS)


@query(
    "failure_rate_trend",
    ask(
        f"""SELECT day, total, failed, {_rounded('failed / total * 100', 1)} AS rate FROM (SELECT {day('created_us')} AS day,
        count(*) AS total, count(*) FILTER (status = 'failed') AS failed FROM runs WHERE created_us >= {SINCE} GROUP BY 1)""",
        "runs",
    ),
)
def failure_rate_trend(spark: SparkSession, sf: str) -> DataFrame:
    return run_history.failure_rate_trend(A.event_runs(spark, sf), A.AS_OF, A.DAYS)


FINISHED = f"status = 'completed' AND completed_us >= {SINCE}"


@query(
    "stats_summary",
    ask(
        f"""SELECT total, completed, failed, {_rounded('micros / timed / 1000000', 2)} AS avg_duration_seconds,
        {_rounded('ai / completed * 100', 1)} AS ai_usage_percent, {_rounded('issues / timed', 1)} AS avg_issues_per_analysis
        FROM (SELECT count(*) FILTER (created_us >= {SINCE}) AS total,
          count(*) FILTER (created_us >= {SINCE} AND status = 'completed') AS completed,
          count(*) FILTER (created_us >= {SINCE} AND status = 'failed') AS failed,
          CAST(sum(completed_us - started_us) FILTER ({FINISHED}) AS BIGINT) AS micros, count(*) FILTER ({FINISHED}) AS timed,
          count(*) FILTER ({FINISHED} AND with_report) AS ai FROM runs),
        (SELECT count(*) AS issues FROM results JOIN runs USING (task_id) WHERE {FINISHED})""",
        "results",
    ),
)
def stats_summary(spark: SparkSession, sf: str) -> DataFrame:
    return run_history.stats_summary(A.stored_run_rows(spark, sf), A.stored_result_rows(spark, sf), A.AS_OF, A.DAYS)


OLDEST = "(completed_us, task_id, -sev_order, -rule_ord, -coalesce(stage_id, -1))"


@query(
    "rule_frequency",
    ask(
        f"""SELECT rule_id, arg_min(title, {OLDEST}) AS title, count(*) AS count, arg_min(severity, {OLDEST}) AS severity
        FROM results JOIN runs USING (task_id) WHERE {FINISHED} GROUP BY 1""",
        "results",
    ).replace("runs USING (task_id)", "(SELECT task_id, status, completed_us FROM runs) USING (task_id)"),
)
def rule_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return run_history.rule_frequency(A.stored_run_rows(spark, sf), A.stored_result_rows(spark, sf), A.AS_OF, A.DAYS)


@query(
    "top_issues",
    ask(
        f"""SELECT rule_id, arg_min(title, {OLDEST}) AS title, arg_min(message, {OLDEST}) AS message, count(*) AS count,
        arg_min(severity, {OLDEST}) AS severity, arg_max(app_id, (completed_us, task_id)) AS example_app_id
        FROM results JOIN (SELECT task_id, status, completed_us, app_id FROM runs) USING (task_id) WHERE {FINISHED}
        GROUP BY 1 ORDER BY count DESC, rule_id LIMIT 10""",
        "results",
    ),
)
def top_issues(spark: SparkSession, sf: str) -> DataFrame:
    return run_history.top_issues(A.stored_run_rows(spark, sf), A.stored_result_rows(spark, sf), A.AS_OF, A.DAYS)


@query(
    "severity_trend",
    ask(
        f"""SELECT {day('completed_us')} AS day, count(*) FILTER (severity = 'CRITICAL') AS critical,
        count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info
        FROM (SELECT task_id, status, completed_us FROM runs WHERE {FINISHED}) LEFT JOIN results USING (task_id) GROUP BY 1""",
        "results",
    ),
)
def severity_trend(spark: SparkSession, sf: str) -> DataFrame:
    return run_history.severity_trend(A.stored_run_rows(spark, sf), A.stored_result_rows(spark, sf), A.AS_OF, A.DAYS)


@query(
    "duration_by_mode",
    ask(
        f"""SELECT mode, {_rounded('micros / count / 1000000', 2)} AS avg_duration_seconds, count FROM (SELECT mode,
        CAST(sum(completed_us - started_us) AS BIGINT) AS micros, count(*) AS count FROM runs WHERE {FINISHED} GROUP BY 1)""",
        "runs",
    ),
)
def duration_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    return run_history.duration_by_mode(A.event_runs(spark, sf), A.AS_OF, A.DAYS)


@query(
    "group_runs_by_app",
    ask(
        """SELECT app_id, count(*) AS runs, arg_max(task_id, (created_us, task_id)) AS newest_task_id,
        string_agg(task_id, ',' ORDER BY created_us DESC, task_id DESC) AS task_ids FROM
        (SELECT * FROM runs ORDER BY created_us DESC, task_id DESC LIMIT 200) GROUP BY 1""",
        "runs",
    ),
)
def group_runs_by_app(spark: SparkSession, sf: str) -> DataFrame:
    page = run_history.list_runs(A.event_runs(spark, sf), limit=200)
    return run_history.group_runs_by_app(page).withColumn("task_ids", F.array_join("task_ids", ","))


@query(
    "list_applications",
    ask(
        """SELECT id, name, CASE WHEN attempts > 0 THEN '2024-01-0' || attempts || 'T00:00:00.000GMT' ELSE '' END
        AS start_time, CASE WHEN attempts > 0 THEN '2024-01-0' || attempts || 'T01:00:00.000GMT' ELSE '' END AS end_time,
        CASE WHEN attempts > 0 THEN k * 1000 + attempts ELSE 0 END AS duration_ms, attempts % 2 = 1 AS completed,
        CASE WHEN attempts > 0 THEN '3.' || attempts || '.' || (k % 3) ELSE '' END AS spark_version,
        CASE WHEN attempts > 0 THEN 'user' || attempts ELSE '' END AS user,
        (SELECT count(*) FROM runs WHERE runs.app_id = id) AS analysis_count,
        (SELECT least(count(*), 25) FROM applications) AS fetched FROM applications
        ORDER BY k DESC, id DESC LIMIT 20 OFFSET 5""",
        "applications",
        "runs",
    ),
)
def list_applications(spark: SparkSession, sf: str) -> DataFrame:
    return run_history.list_applications(
        A.supplier_applications(spark, sf), A.event_runs(spark, sf), newest="k", limit=20, offset=5
    )


@query(
    "search_applications",
    ask("SELECT id, name FROM applications WHERE contains(lower(id), 'r#00000000') OR contains(lower(name), 'r#00000000')",
        "applications"),
)
def search_applications(spark: SparkSession, sf: str) -> DataFrame:
    return run_history.search_applications(A.supplier_applications(spark, sf), "R#00000000").select("id", "name")


# ------------------------------------------------------------ incremental and streaming

CAP = 700


def _processed(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the runs' ids, stamped with their creation."""
    chosen = A.event_runs(spark, sf).filter("mode <> 'agent'")
    return chosen.selectExpr("task_id AS key", "created_at AS processed_at")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return A.event_runs(spark, sf).filter("status <> 'pending'").selectExpr("task_id AS key", "status")


CANDIDATES_SQL = "SELECT task_id AS key, status FROM runs WHERE status <> 'pending'"


@query("filter_new", ask(f"SELECT * FROM ({CANDIDATES_SQL}) WHERE key IN (SELECT task_id FROM runs WHERE mode = 'agent')", "runs"))
def filter_new(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.filter_new(_candidates(spark, sf), _processed(spark, sf))


@query(
    "filter_new_and_mark",
    ask(
        f"""SELECT key, us AS processed_us FROM (SELECT task_id AS key, created_us AS us FROM runs WHERE mode <> 'agent'
        UNION ALL SELECT task_id, epoch_us(TIMESTAMP '2024-01-31 00:00:00') FROM runs WHERE mode = 'agent'
        AND status <> 'pending') ORDER BY us DESC, key LIMIT {CAP}""",
        "runs",
    ),
)
def filter_new_and_mark(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(A.AS_OF).cast("timestamp")
    _, table = dedup.filter_new_and_mark(_candidates(spark, sf), _processed(spark, sf), now, CAP)
    return table.selectExpr("key", "unix_micros(processed_at) AS processed_us")


@query(
    "filter_new_and_mark_all",
    ask(
        """SELECT task_id AS key, created_us AS processed_us FROM runs WHERE mode <> 'agent'
        UNION ALL SELECT task_id, epoch_us(TIMESTAMP '2024-01-31 00:00:00') FROM runs WHERE mode = 'agent'
        AND status <> 'pending'""",
        "runs",
    ),
)
def filter_new_and_mark_all(spark: SparkSession, sf: str) -> DataFrame:
    """Without a cap every key is kept."""
    now = F.lit(A.AS_OF).cast("timestamp")
    _, table = dedup.filter_new_and_mark(_candidates(spark, sf), _processed(spark, sf), now)
    return table.selectExpr("key", "unix_micros(processed_at) AS processed_us")


@query(
    "evict_processed",
    ask(
        f"""SELECT task_id AS key, created_us AS processed_us FROM runs WHERE mode <> 'agent'
        ORDER BY created_us DESC, task_id LIMIT {CAP}""",
        "runs",
    ),
)
def evict_processed(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup.evict_processed(_processed(spark, sf), CAP)
    return kept.selectExpr("key", "unix_micros(processed_at) AS processed_us")


@query(
    "retry_failed",
    ask("SELECT task_id AS key FROM runs WHERE mode <> 'agent' AND status <> 'failed'", "runs"),
)
def retry_failed(spark: SparkSession, sf: str) -> DataFrame:
    failed = A.event_runs(spark, sf).filter("status = 'failed'").selectExpr("task_id AS key")
    return dedup.retry_failed(_processed(spark, sf), failed).select("key")


@query(
    "admit_requests",
    ask(
        """WITH latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY app_id
          ORDER BY created_us DESC, task_id DESC) = 1),
        requests AS (SELECT o_orderkey AS request_id, 'app_' || (o_custkey % 120) AS app_id, o_custkey % 3 = 0 AS rerun
          FROM orders)
        SELECT request_id, r.app_id, rerun, CASE WHEN (l.task_id IS NULL OR l.status IN ('completed', 'failed')) AND
          request_id = min(request_id) OVER (PARTITION BY r.app_id) THEN 'create' WHEN rerun THEN 'conflict' ELSE 'skip' END
          AS decision, CASE WHEN l.status IN ('pending', 'running') THEN l.task_id END AS active_task_id
        FROM requests r LEFT JOIN latest l ON l.app_id = r.app_id""",
        "runs",
    ).replace(" WITH latest AS", ", latest AS", 1),
)
def admit_requests(spark: SparkSession, sf: str) -> DataFrame:
    requests = A.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS request_id", "concat('app_', o_custkey % 120) AS app_id", "o_custkey % 3 = 0 AS rerun"
    )
    return run_state.admit_requests(requests, A.event_runs(spark, sf))


STATE_SQL = ask(
    "SELECT task_id, app_id, mode, status, created_us, started_us, completed_us, error FROM runs",
    "runs",
)
STATE_EXPRS = [e for e in RUN_EXPRS if e != "data_source"]


@query("run_state", STATE_SQL)
def run_state_query(spark: SparkSession, sf: str) -> DataFrame:
    return run_state.run_state(A.status_log(spark, sf)).selectExpr(*STATE_EXPRS)


def _streamed_status(spark: SparkSession, sf: str) -> DataFrame:
    """The status log as a file stream."""
    path = A.staged_path(spark, sf, "status", lambda path: A.status_log(spark, sf).write.parquet(path))
    return spark.readStream.schema(A.status_log(spark, sf).schema).parquet(path)


def _finished(spark: SparkSession, start, mode: str = "append") -> DataFrame:
    """Runs a stream to its end and reads back what it wrote.

    In append mode every batch counts; otherwise a later batch replaces the rows it repeats.
    """
    out, checkpoint = new_path(spark, "stream"), new_path(spark, "checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    start(write, checkpoint).awaitTermination()
    written = spark.read.parquet(out)
    return written.drop("batch") if mode == "append" else written


@query("run_state_stream", STATE_SQL)
def run_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    stream = _streamed_status(spark, sf)
    updates = _finished(spark, lambda w, c: status_stream.stream_run_state(stream, w, c), "update")
    columns = [c for c in updates.columns if c not in ("batch", "task_id")]
    latest = updates.groupBy("task_id").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("task_id", "r.*")
    return latest.selectExpr(*STATE_EXPRS)


STATUS_LOG_SQL = """
SELECT task_id, app_id, 'pending' AS status, created_us AS us, NULL AS error FROM runs UNION ALL
SELECT task_id, app_id, 'running', started_us, NULL FROM runs WHERE started_us IS NOT NULL UNION ALL
SELECT task_id, app_id, status, completed_us, error FROM runs WHERE completed_us IS NOT NULL"""


@query("status_feed", ask(f"SELECT * FROM ({STATUS_LOG_SQL}) WHERE task_id IN (SELECT task_id FROM runs WHERE mode = 'ai')", "runs"))
def status_feed(spark: SparkSession, sf: str) -> DataFrame:
    stream = _streamed_status(spark, sf)
    wanted = A.event_runs(spark, sf).filter("mode = 'ai'").select("task_id")
    feed = _finished(spark, lambda w, c: status_stream.stream_status_feed(stream, w, c, wanted))
    return feed.selectExpr("task_id", "app_id", "status", "unix_micros(ts) AS us", "error")


RATE_SQL = """SELECT (us // 60000000 - i) * 60000000 AS window_us, {label}, count(*) AS events, count(*) / 300 AS rate
  FROM ({source}), (SELECT unnest(range(5)) AS i) GROUP BY ALL"""


@query("window_rate", ask(RATE_SQL.format(label="status", source=STATUS_LOG_SQL), "runs"))
def window_rate(spark: SparkSession, sf: str) -> DataFrame:
    rates = run_state.window_rate(A.status_log(spark, sf), ["status"])
    return rates.selectExpr("unix_micros(window_start) AS window_us", "status", "events", "rate")


@query(
    "stream_window_rate",
    ask(
        f"""SELECT * FROM ({RATE_SQL.format(label="status", source=STATUS_LOG_SQL)}) WHERE window_us + 300000000 <=
        (SELECT max(us) FROM ({STATUS_LOG_SQL})) // 1000 * 1000 - 600000000""",
        "runs",
    ),
)
def stream_window_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The windows that the watermark has passed when the stream has read all status events."""
    stream = _streamed_status(spark, sf)
    rates = _finished(
        spark, lambda w, c: status_stream.stream_window_rate(stream, ["status"], w, c, watermark="10 minutes")
    )
    return rates.selectExpr("unix_micros(window_start) AS window_us", "status", "events", "rate")


@query(
    "window_rate_findings",
    ask(
        """SELECT (completed_us // 60000000 - i) * 60000000 AS window_us, count(*) AS events, count(*) / 300 AS rate
        FROM results JOIN (SELECT task_id, completed_us FROM runs) USING (task_id), (SELECT unnest(range(5)) AS i)
        GROUP BY ALL""",
        "results",
    ),
)
def window_rate_findings(spark: SparkSession, sf: str) -> DataFrame:
    stamped = A.event_results(spark, sf).select("task_id").join(
        A.event_runs(spark, sf).select("task_id", "completed_at"), "task_id"
    )
    rates = run_state.window_rate(stamped, [], stamp="completed_at")
    return rates.selectExpr("unix_micros(window_start) AS window_us", "events", "rate")


@query(
    "run_totals",
    ask(
        f"""SELECT total, started, completed, failed, completed / started * 100 AS success_percent,
        {_rounded('completed / total * 100', 1)} AS completed_percent FROM (SELECT count(*) AS total,
        count(started_us) AS started, count(*) FILTER (status = 'completed') AS completed,
        count(*) FILTER (status = 'failed') AS failed FROM runs)""",
        "runs",
    ),
)
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return run_state.run_totals(A.event_runs(spark, sf))


HISTOGRAM_SQL = """SELECT mode, le, count(*) FILTER ((completed_us - started_us) / 1000000 <= le) AS cumulative FROM
  (SELECT * FROM runs WHERE status = 'completed'), (SELECT unnest([1, 5, 10, 30, 60, 120, 300, 'Infinity'::DOUBLE]) AS le)
  GROUP BY ALL"""


@query("duration_histogram", ask(f"SELECT mode, CAST(le AS VARCHAR) AS le, cumulative FROM ({HISTOGRAM_SQL})", "runs"))
def duration_histogram(spark: SparkSession, sf: str) -> DataFrame:
    histogram = run_state.duration_histogram(A.event_runs(spark, sf))
    return histogram.selectExpr("mode", "if(le = double('inf'), 'inf', string(le)) AS le", "cumulative")


@query(
    "histogram_quantile",
    ask(
        f"""SELECT mode, quantile, CASE WHEN isinf(le) THEN 300 ELSE lower + (le - lower) * ((quantile * n - below) /
        (cumulative - below)) END AS estimate FROM (SELECT *, lag(le, 1, 0) OVER w AS lower, lag(cumulative, 1, 0) OVER w
        AS below, max(cumulative) OVER (PARTITION BY mode, quantile) AS n FROM ({HISTOGRAM_SQL}),
        (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS quantile) WINDOW w AS (PARTITION BY mode, quantile ORDER BY le))
        WHERE cumulative >= quantile * n QUALIFY row_number() OVER (PARTITION BY mode, quantile ORDER BY le) = 1""",
        "runs",
    ),
)
def histogram_quantile(spark: SparkSession, sf: str) -> DataFrame:
    histogram = run_state.duration_histogram(A.event_runs(spark, sf))
    estimates = [
        run_state.histogram_quantile(histogram, q).withColumn("quantile", F.lit(q)) for q in (0.5, 0.95)
    ]
    return estimates[0].unionByName(estimates[1])


@query(
    "label_totals",
    ask(
        """SELECT * FROM (SELECT 'rule' AS label, rule_id AS name, count(*) AS total FROM results GROUP BY ALL
        ORDER BY total DESC, name LIMIT 10) UNION ALL
        SELECT 'severity', severity, count(*) FROM results GROUP BY ALL UNION ALL
        SELECT 'mode', mode, count(started_us) FROM runs GROUP BY ALL""",
        "results",
    ),
)
def label_totals(spark: SparkSession, sf: str) -> DataFrame:
    results = A.event_results(spark, sf)
    started = A.event_runs(spark, sf).filter("started_at IS NOT NULL")
    parts = (
        ("rule", "rule_id", run_state.label_totals(results, "rule_id", 10)),
        ("severity", "severity", run_state.label_totals(results, "severity")),
        ("mode", "mode", run_state.label_totals(started, "mode")),
    )
    named = [df.selectExpr(f"'{label}' AS label", f"{column} AS name", "total") for label, column, df in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    "label_totals_stream",
    ask("SELECT status, count(*) AS total FROM (" + STATUS_LOG_SQL + ") GROUP BY 1", "runs"),
)
def label_totals_stream(spark: SparkSession, sf: str) -> DataFrame:
    stream = _streamed_status(spark, sf)
    totals = _finished(spark, lambda w, c: status_stream.stream_label_totals(stream, "status", w, c), "complete")
    last = totals.agg(F.max("batch")).scalar()
    return totals.filter(F.col("batch") == last).drop("batch")


@query("stream_event_logs", ask(LOG_STAGE_SQL, "log_stages", "log_rollup"))
def stream_event_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Logs picked up batch by batch; each batch publishes the stage metrics of its logs."""
    out, checkpoint = new_path(spark, "published"), new_path(spark, "checkpoint")

    def publish(fleet: Fleet, batch_id: int) -> None:
        fleet.stages.selectExpr(*LOG_STAGE_EXPRS).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # one stream: its checkpoint goes on where the round before ended
    for source, _ in A.log_folders(spark, sf):
        log_stream.stream_event_logs(spark, source, checkpoint, publish, max_files=10_000).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query(
    "poll_logs",
    ask(
        """SELECT log_id, CASE WHEN log_id IN (SELECT min(log_id) FROM logs UNION ALL SELECT max(log_id) FROM logs) THEN 2 ELSE 1 END
        AS attempts, CASE WHEN log_id = (SELECT min(log_id) FROM logs) THEN 'failed' ELSE 'done' END AS status,
        CASE WHEN log_id <> (SELECT min(log_id) FROM logs) THEN task_count END AS tasks,
        CASE WHEN log_id <> (SELECT min(log_id) FROM logs) THEN sum_run_ms END AS run_ms
        FROM logs LEFT JOIN (SELECT s.log_id, CAST(coalesce(sum(u.task_count), 0) AS BIGINT) AS task_count,
        CAST(coalesce(sum(u.sum_run_ms), 0) AS BIGINT) AS sum_run_ms FROM log_stages s LEFT JOIN log_rollup u
        ON u.log_id = s.log_id AND u.stage_id = s.stage_id GROUP BY s.log_id) USING (log_id)""",
        "logs",
        "log_stages",
        "log_rollup",
    ),
)
def poll_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Three polls over all logs: one cut short is given up, one that is mended after the first poll is folded by the second."""
    folder, state, out = (new_path(spark, name) for name in ("arriving", "polls", "published"))
    A.damaged_logs(spark, sf, folder)

    def publish(fleet: Fleet, part: str) -> None:
        stages = fleet.stages.groupBy("log_path").agg(F.sum("task_count").alias("tasks"), F.sum("sum_run_ms").alias("run_ms"))
        stages.write.mode("overwrite").parquet(f"{out}/part={part}")

    for poll in range(3):
        retries = log_retries.Retries(attempts=2, backoff_ms=1)
        log_retries.poll_logs(spark, folder, state, publish, retries).awaitTermination()
        if poll == 0:
            A.mend_last_log(spark, sf, folder)
    folded = spark.read.parquet(out).selectExpr(LOG_ID, "tasks", "run_ms")
    settled = log_retries.settled_logs(spark, state).selectExpr(LOG_ID, "attempt AS attempts", "status")
    return settled.join(folded, "log_id", "left")


@query(
    "commit_runs",
    ask(
        """SELECT r.task_id, any_value(r.app_id) AS app_id, 'job ' || any_value(r.app_id) AS app_name, any_value(CAST(r.task_id AS BIGINT))
        AS duration_ms, r.task_id AS run_setting, 1::BIGINT AS stages, bool_and(with_report) AS has_report, count(f.rule_id) AS findings,
        count(f.rule_id) FILTER (f.severity = 'CRITICAL') AS critical
        FROM runs r LEFT JOIN results f ON f.task_id = r.task_id WHERE r.status = 'completed' GROUP BY r.task_id""",
        "runs",
        "results",
    ),
)
def commit_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of all completed runs, put together from the committed tables and parsed again."""
    tables = A.run_tables(spark, sf)
    parsed = read_documents(tables, tables.runs).selectExpr("task_id", "parse_json(result_json) AS d")
    found = parsed.selectExpr("*", "variant_get(d, '$.rule_results', 'array<variant>') AS found")
    return found.selectExpr(
        "task_id",
        "variant_get(d, '$.app_id', 'string') AS app_id",
        "variant_get(d, '$.job.app_name', 'string') AS app_name",
        "variant_get(d, '$.job.duration_ms', 'bigint') AS duration_ms",
        """variant_get(d, "$.job.config['spark.app.run']", 'string') AS run_setting""",
        "bigint(size(variant_get(d, '$.job.stages', 'array<variant>'))) AS stages",
        "try_variant_get(d, '$.ai_report', 'map<string,variant>') IS NOT NULL AS has_report",
        "bigint(size(found)) AS findings",
        "bigint(size(filter(found, f -> variant_get(f, '$.severity', 'string') = 'CRITICAL'))) AS critical",
    )


# The statistics of a window from daily partials, and the rows of its first day, answer the same questions.


@query("daily_rule_frequency", ORACLES["rule_frequency"])
def daily_rule_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return daily.rule_frequency(A.run_tables(spark, sf), A.AS_OF, A.DAYS)


@query("daily_top_issues", ORACLES["top_issues"])
def daily_top_issues(spark: SparkSession, sf: str) -> DataFrame:
    return daily.top_issues(A.run_tables(spark, sf), A.AS_OF, A.DAYS)


@query("daily_severity_trend", ORACLES["severity_trend"])
def daily_severity_trend(spark: SparkSession, sf: str) -> DataFrame:
    return daily.severity_trend(A.run_tables(spark, sf), A.AS_OF, A.DAYS)


@query("daily_duration_by_mode", ORACLES["duration_by_mode"])
def daily_duration_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    return daily.duration_by_mode(A.run_tables(spark, sf), A.AS_OF, A.DAYS)


@query("daily_stats_summary", ORACLES["stats_summary"])
def daily_stats_summary(spark: SparkSession, sf: str) -> DataFrame:
    return daily.stats_summary(A.run_tables(spark, sf), A.AS_OF, A.DAYS)
