"""Turns the given tables into task, job, run and payload tables.

One ``lineitem`` row is one finished task, one ``supplier`` is one application, one ``event`` is one
analysis run, one ``part`` is one recommendation. Work therefore grows with the tables.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator
from dataclasses import replace
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions.text import literal
from fleetgauge.operators.metrics import LOG_MEASURES, stage_metrics
from fleetgauge.plans.rules import BUILT_IN, evaluate_rules
from fleetgauge.schemas import EXECUTOR_COLUMNS, REPORT
from fleetgauge.session import configure, shuffles_dropped
from fleetgauge.sources.codec_ranges import opened
from fleetgauge.sources.history_payloads import (
    APPLICATIONS,
    ENVIRONMENTS,
    EXECUTORS,
    STAGES,
    SUMMARIES,
    HistoryPayloads,
    scan_history_json,
)
from fleetgauge.sources.run_tables import RunTables, commit_runs
from fleetgauge.sources.runs import result_documents, result_rows, run_rows, scan_runs, sink_results
from fleetgauge.sources.staging import drop_folder, make_folder, new_path, stage_table
from fleetgauge.thresholds import MIB, Thresholds

AS_OF = "2024-01-31 00:00:00"
DAYS = 7
# with eight stages a job cannot reach the default of five repeated names
THRESHOLDS = Thresholds(min_duplicate_stages_for_warning=2)
# input quantiles are optional for event logs; the tables have them
MEASURES = {**LOG_MEASURES, "input_metrics.bytes": "input_bytes"}
ORDERS_PER_LOG = 200_000
# Log files take many times the room of the tasks they are made from, so larger tables give theirs in rounds.
TASKS_PER_ROUND = 2_000_000

_staged: dict[tuple, str] = {}
_plans: dict[tuple, DataFrame] = {}
_rounds: dict[tuple, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_plan(build):
    """Builds a (lazy) table once per session and folder; nothing is computed or kept but its plan."""

    @wraps(build)
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _plans:
            _plans[key] = build(spark, sf_dir)
        return _plans[key]

    return plan


@shared_plan
def lineitem_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task table, written once per session. The given file is one row group, so one task would read it."""
    return stage_table(derived_tasks(spark, sf_dir), "tasks", row_group_bytes=4 * MIB)


def derived_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task rows keyed by ``app_id``; ``k`` and ``log_no`` are kept for the log and payload writers."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        *("l_orderkey", "l_suppkey AS k", "l_linenumber AS line", "l_quantity AS qty", "l_extendedprice AS price"),
        *("l_discount", "l_tax", "l_returnflag", "l_partkey % 8 AS stage_id"),
    )
    # the late stages of some applications neither collect garbage, shuffle nor spill
    rows = rows.selectExpr("*", "pow(qty, 1 + k % 4) AS power", "stage_id > 2 AND k % 7 = 0 AS quiet")
    spill = "if(stage_id = 5 AND k % 2 = 0 AND NOT quiet, bigint(floor(price * l_tax * 10000)), 0L)"
    return rows.selectExpr(
        "concat('app_', k) AS app_id",
        "k",
        f"bigint(l_orderkey / {ORDERS_PER_LOG}) AS log_no",
        "line",
        "stage_id",
        "10 * bigint(floor(power)) + 50 * line AS duration_ms",
        "10 * bigint(floor(power)) AS run_ms",
        "if(quiet, 0L, bigint(floor(power * 10 * l_discount * stage_id * 2))) AS gc_ms",
        "if(stage_id >= 4 AND NOT quiet, bigint(floor(price * 1000)), 0L) AS shuffle_read_bytes",
        "if(stage_id >= 4 AND NOT quiet, bigint(qty), 0L) AS shuffle_read_records",
        "if(quiet, 0L, bigint(floor(price * 500 * (k % 3)))) AS shuffle_write_bytes",
        "if(quiet, 0L, bigint(qty)) AS shuffle_write_records",
        "if(stage_id < 4, 10 * bigint(floor(price * qty * (1 + k % 5))), 0L) AS input_bytes",
        "if(stage_id < 4, bigint(qty), 0L) AS input_records",
        "bigint(line) AS output_records",
        f"{spill} AS spill_disk_bytes",
        f"2 * {spill} AS spill_memory_bytes",
        "l_returnflag = 'R' AND line = 1 AND k % 3 = 0 AS failed",
        "l_returnflag = 'A' AND line = 2 AND k % 5 = 0 AS killed",
    )


# stage 7 of some applications never completes
COMPLETES = "NOT (stage_id = 7 AND k % 11 = 3)"


def stage_records(tasks: DataFrame) -> DataFrame:
    """Completion records of the stages that ran tasks."""
    return tasks.filter(COMPLETES).groupBy("app_id", "stage_id").agg(
        F.sum("input_bytes").alias("input_bytes"),
        F.expr("sum(output_records) * 1000 AS output_bytes"),
        F.expr("concat('stage ', stage_id % 4) AS stage_name"),
    )


def idle_stage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed stages that ran no task."""
    chosen = table(spark, sf_dir, "supplier").filter("s_suppkey % 13 = 0")
    return chosen.selectExpr(
        "concat('app_', s_suppkey) AS app_id",
        "8L AS stage_id",
        "0L AS input_bytes",
        "0L AS output_bytes",
        "'stage 0' AS stage_name",
    )


def folded_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage metrics from the task rows."""
    tasks = lineitem_tasks(spark, sf_dir)
    records = stage_records(tasks).unionByName(idle_stage_records(spark, sf_dir))
    return stage_metrics(records, tasks, measures=MEASURES)


@shared_plan
def fleet_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage metrics, computed and written once per session; everything about stages reads them."""
    return stage_table(folded_stages(spark, sf_dir), "stages")


def pick(selector: str, *values: str | None) -> str:
    """Value at position ``selector``; None means unset."""
    items = ("NULL" if v is None else literal(v) for v in values)
    return f"get(array({', '.join(items)}), int({selector}))"


def supplier_config(k: str = "k") -> str:
    """Property map of application ``k``; unset properties are left out."""
    settings = {
        "spark.executor.cores": "'4'",
        "spark.executor.memory": pick(f"{k} % 2", "4g", None),
        "spark.executor.memoryOverhead": f"if({k} % 8 = 1, '512m', NULL)",
        "spark.driver.memory": pick(f"{k} % 6", "256m", "1g", "20g", "4g", "4096", "4g"),
        "spark.sql.adaptive.enabled": pick(f"{k} % 3", "false", "True", None),
        "spark.sql.shuffle.partitions": pick(f"{k} % 4", "10", "2000", "200", None),
        "spark.sql.autoBroadcastJoinThreshold": pick(f"{k} % 4", None, "-1", "1048576", None),
        "spark.serializer": pick(f"{k} % 2", "org.apache.spark.serializer.KryoSerializer", None),
        "spark.dynamicAllocation.enabled": pick(f"{k} % 5", "false", "true", None, None, "true"),
        "spark.dynamicAllocation.minExecutors": f"if({k} % 10 = 4, '2', NULL)",
        "spark.dynamicAllocation.maxExecutors": f"if({k} % 10 IN (4, 9), '20', NULL)",
        "spark.memory.fraction": f"if({k} % 3 = 1, '0.6', NULL)",
        "spark.app.tag": f"concat('t', {k})",
    }
    pairs = ", ".join(f"'{key}', {value}" for key, value in settings.items())
    return f"map_filter(map({pairs}), (name, v) -> v IS NOT NULL)"


VERSIONS = ("", "2.4.8", "3.0.1", "3.4.1", "3.5.0")


@shared_plan
def fleet_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    task_time = lineitem_tasks(spark, sf_dir).groupBy("k").agg(F.sum("run_ms").alias("task_ms"))
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_name")
    count = "CASE k % 7 WHEN 6 THEN 0 WHEN 5 THEN 60 ELSE 10 END"
    executors = {
        "ex_count": count,
        "ex_peak_mem": f"(k % 10 * 10 + 5) * {MIB}",
        "ex_alloc_mem": f"{100 * MIB}",
        "ex_task_ms": "coalesce(task_ms, 0)",
        "ex_gc_ms": "k * 10",
        "ex_shuffle_read": "k * 1000",
        "ex_shuffle_write": "k * 500",
        "ex_failed": "k % 3",
        "ex_cores": f"if(k % 2 = 0, {count} * 4, 0)",
    }
    return suppliers.join(task_time, "k", "left").selectExpr(
        "concat('app_', k) AS app_id",
        "s_name AS app_name",
        f"{pick('k % 5', *VERSIONS)} AS spark_version",
        "bigint(200000 + 50000 * (k % 8)) AS duration_ms",
        f"{supplier_config()} AS config",
        *[f"bigint(if(k % 9 = 8, NULL, {value})) AS {name}" for name, value in executors.items()],
    )


@shared_plan
def fleet_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_rules(fleet_stages(spark, sf_dir), fleet_jobs(spark, sf_dir), THRESHOLDS)


MODES = ("static", "ai", "agent")
SOURCES = ("hs_manual", "hs_poller", "file", "k8s", "hdfs", "s3", "gcs", "storage")


# Run status by kind of event.
STATUS = (
    "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed'"
    " ELSE 'completed' END"
)


@shared_plan
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows, with ``has_result`` and ``has_report``."""
    events = table(spark, sf_dir, "events").selectExpr(
        "*", f"{STATUS} AS status", "unix_micros(timestamp(ts)) AS at", "bigint(floor(value * 1000000)) AS elapsed"
    )
    return events.selectExpr(
        "string(event_id) AS task_id",
        "concat('app_', user_id % 100) AS app_id",
        f"{pick('event_id % 3', *MODES)} AS mode",
        f"{pick('event_id % 8', *SOURCES)} AS data_source",
        "status",
        "timestamp_micros(at) AS created_at",
        "if(status <> 'pending', timestamp_micros(at + 1000000), NULL) AS started_at",
        "if(status IN ('completed', 'failed'), timestamp_micros(at + 1000000 + elapsed), NULL) AS completed_at",
        "if(status = 'failed', concat('failed in ', props), NULL) AS error",
        "status = 'completed' AS has_result",
        "status = 'completed' AND event_id % 3 <> 0 AS has_report",
    )


@shared_plan
def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of completed runs: those of the run's application."""
    runs = event_runs(spark, sf_dir).filter("status = 'completed'").select("task_id", "app_id")
    return runs.join(fleet_findings(spark, sf_dir), "app_id").drop("app_id")


@shared_plan
def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only status events of the runs."""
    steps = (
        "array(named_struct('status', 'pending', 'ts', created_at, 'error', string(NULL)),"
        " named_struct('status', 'running', 'ts', started_at, 'error', string(NULL)),"
        " named_struct('status', status, 'ts', completed_at, 'error', error))"
    )
    unfolded = event_runs(spark, sf_dir).selectExpr("task_id", "app_id", "mode", f"inline({steps})")
    return unfolded.filter("ts IS NOT NULL")


PARAMETERS = (
    "spark.executor.memory",
    "spark.sql.shuffle.partitions",
    "spark.memory.fraction",
    "",
    "spark.sql.autoBroadcastJoinThreshold",
)


@shared_plan
def part_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations of applications, in order of the part key."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('app_', p_partkey % 100) AS app_id",
        "p_partkey AS pos",
        "bigint(p_size % 5) AS priority",
        "p_name AS title",
        f"{pick('p_size % 5', *PARAMETERS)} AS parameter",
        "if(p_size % 3 = 0, '', concat('c', p_size)) AS current_value",
        "if(p_size % 7 = 0, '', concat(p_size, 'g')) AS recommended_value",
        "concat('because of ', p_brand) AS explanation",
        "concat('saves ', p_size, '%') AS estimated_impact",
        "p_type AS risk",
    )


@shared_plan
def supplier_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report headers of all applications."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('app_', s_suppkey) AS app_id",
        "concat('Summary of ', s_name) AS summary",
        f"{pick('s_suppkey % 3', 'critical', 'Warning', 'Warning')} AS severity",
        "concat('stage ', s_suppkey % 9, ' waits') AS causal_chain",
    )


def staged_path(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Writes a derived input once per session and returns where."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        path = new_path(spark, name)
        write(path)
        _staged[key] = path
    return _staged[key]


@shared_plan
def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as result documents and read back."""

    def write(path: str) -> None:
        runs = event_runs(spark, sf_dir)
        known = {"app_id": "app_id", "summary": "concat('run ', task_id)", "severity": "'INFO'"}
        fields = ", ".join(f"'{f.name}', cast({known.get(f.name, 'NULL')} AS {f.dataType.simpleString()})" for f in REPORT)
        reports = runs.filter("has_report").selectExpr("task_id", f"named_struct({fields}) AS ai_report")
        sink_results(result_documents(runs, event_results(spark, sf_dir), reports), path)

    path = staged_path(spark, sf_dir, "runs", write)
    return scan_runs(spark, path)


def stored_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_rows(stored_runs(spark, sf_dir))


def stored_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_rows(stored_runs(spark, sf_dir), list(BUILT_IN))


def run_tables(spark: SparkSession, sf_dir: str) -> RunTables:
    """Runs committed in two parts, with a job, one stage and their findings each; each commit is repeated."""

    def write(path: str) -> None:
        runs, results = event_runs(spark, sf_dir), event_results(spark, sf_dir)
        known = {"app_id": "app_id", "summary": "concat('run ', task_id)", "severity": "'INFO'"}
        fields = ", ".join(f"'{f.name}', cast({known.get(f.name, 'NULL')} AS {f.dataType.simpleString()})" for f in REPORT)
        reports = runs.filter("has_report").selectExpr("task_id", f"named_struct({fields}) AS ai_report")
        executors = ", ".join(f"'{c}', bigint(task_id) % 9" for c in EXECUTOR_COLUMNS)
        job = f"""named_struct('app_name', concat('job ', app_id), 'spark_version', '4.0.0', 'duration_ms', bigint(task_id),
            'config', map('spark.app.run', task_id), 'executors', named_struct({executors})) AS job"""
        stages = runs.selectExpr("task_id", "bigint(3) AS stage_id", "to_json(struct(3 AS stage_id, app_id)) AS stage")
        for n in range(2):
            part = runs.filter(f"bigint(task_id) % 2 = {n}")
            commit_runs(part, results, path, runs.selectExpr("task_id", job), reports, stages, name=f"part {n}")
            # a repeated commit changes nothing
            commit_runs(part, results, path, name=f"part {n}")

    return RunTables(spark, staged_path(spark, sf_dir, "run-tables", write))


def file_logs(spark: SparkSession, sf_dir: str) -> str:
    """Event logs written from the tables, half of them gzipped; returns their folder."""
    return staged_path(spark, sf_dir, "logs", lambda path: _write_logs(log_lines(spark, sf_dir), path))


def log_rounds(spark: SparkSession, sf_dir: str) -> list[str]:
    """Conditions on the rows of tasks that deal whole logs to rounds of ``TASKS_PER_ROUND`` tasks at most, or one log."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _rounds:
        # logs without a name are one log; the others hold the tasks of a range of orders
        counts = log_tasks(spark, sf_dir).groupBy(F.expr("if(log_id IS NULL, NULL, log_no) AS log_no")).count()
        _rounds[key] = round_conditions([(r[0], r[1]) for r in counts.orderBy("log_no").collect()], TASKS_PER_ROUND)
    return _rounds[key]


def round_conditions(counts: list[tuple[int | None, int]], most: int) -> list[str]:
    """Conditions of the rounds of logs numbered ``log_no`` (None: without a name), which hold so many tasks, in their order."""
    if sum(n for _, n in counts) <= most:
        return ["true"]
    rounds: list[str] = []
    low, held = None, 0
    for log_no, n in counts:
        if log_no is None:
            rounds.append("log_id IS NULL")
        elif n > most:
            parts = -(-n // most)
            rounds += [f"log_no = {log_no} AND pmod(xxhash64(log_id), {parts}) = {i} AND log_id IS NOT NULL" for i in range(parts)]
        else:
            if low is None or held + n > most:
                low, held = log_no, 0
            else:
                rounds.pop()
            held += n
            rounds.append(f"log_no BETWEEN {low} AND {log_no} AND log_id IS NOT NULL")
            continue
        low = None
    return rounds


def line_rounds(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """Lines of all logs, those of one round after those of the other."""
    for chosen in log_rounds(spark, sf_dir):
        yield log_lines(spark, sf_dir, chosen)


def log_folders(spark: SparkSession, sf_dir: str, name: str = "logs", write=None) -> Iterator[tuple[str, DataFrame]]:
    """A folder with the files of all logs of a round, and their lines: the same folder for each round, whose files go when the next one
    is asked for. Logs of a single round are written once per session."""
    put = write or _write_logs
    if len(log_rounds(spark, sf_dir)) == 1:
        lines = log_lines(spark, sf_dir)
        yield staged_path(spark, sf_dir, name, lambda path: put(lines, path)), lines
        return
    folder = new_path(spark, name)
    for n, lines in enumerate(line_rounds(spark, sf_dir)):
        put(lines, f"{folder}/round-{n}")
        yield folder, lines
        drop_folder(spark, f"{folder}/round-{n}")


def staged_rounds(spark: SparkSession, name: str, rounds: Iterable[DataFrame], *partition_by: str) -> DataFrame:
    """Tables of the same columns, each written before the next one is asked for, read back as one."""
    path = new_path(spark, name)
    for rows in rounds:
        with shuffles_dropped(spark):
            rows.write.partitionBy(*partition_by).mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def codec_log_folders(spark: SparkSession, sf_dir: str) -> Iterator[tuple[str, DataFrame]]:
    """The same logs as real LZ4, Zstandard, Snappy and oddly named gzip files, the first two of many frames."""
    return log_folders(spark, sf_dir, "codec-logs", _write_codec_logs)


def _write_codec_logs(lines: DataFrame, path: str) -> None:
    dealt = lines.selectExpr("*", "pmod(xxhash64(value), 4) AS piece")
    texts = dealt.groupBy("log_id", "piece").agg(
        F.expr("array_sort(collect_list(struct(phase, ord, value))).value AS lines")
    )

    def run(batches):
        for batch in batches:
            for log_id, piece, lines in zip(*(c.to_pylist() for c in batch.columns)):
                _write_codec_file(path, log_id, piece, [f"{line}\n".encode() for line in lines])
            yield batch.select(["log_id"])

    # a task that runs again writes the same files again
    with shuffles_dropped(lines.sparkSession):
        texts.select("log_id", "piece", "lines").mapInArrow(run, "log_id string").count()


def first_and_last_log(lines: DataFrame) -> tuple[str | None, str | None]:
    """Ids of the first and the last log. Every log begins with one line, so only those are looked at."""
    return lines.filter("phase = 0").agg(F.min("log_id"), F.max("log_id")).first()


def log_text(lines: DataFrame, log_id: str | None) -> DataFrame:
    """The whole text of one log."""
    # a filter on the id reaches the tasks, so no line of another log is made
    chosen = lines.filter(F.col("log_id") == F.lit(log_id))
    return chosen.groupBy("log_id").agg(
        F.expr("array_join(array_sort(collect_list(struct(phase, ord, value))).value, '\n') AS text")
    )


def damaged_logs(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """All logs, the first one as a gzip file cut short and the last one as a Snappy block that cannot be read."""
    lines = log_lines(spark, sf_dir)
    first, last = first_and_last_log(lines)
    ends = F.col("log_id").eqNullSafe(F.lit(first)) | F.col("log_id").eqNullSafe(F.lit(last))
    _write_logs(lines.filter(F.col("log_id").isNull() | ~ends), folder)
    if first != last:
        put_logs(log_text(lines, first), folder, "gz", lambda data: gzip.compress(data)[:-20])
    put_logs(log_text(lines, last), folder, "snappy", lambda data: b"\xff\xff\xff\xff\x0f" + data[:20])


def mend_last_log(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Replaces the Snappy block by a good one."""
    lines = log_lines(spark, sf_dir)
    last = log_text(lines, first_and_last_log(lines)[1])
    put_logs(last, folder, "snappy", lambda data: pa.compress(data, codec="snappy", asbytes=True))


def put_logs(texts: DataFrame, folder: str, suffix: str, encode) -> None:
    """Writes each text as one file; a task that runs again writes the same file again."""

    def run(batches):
        for batch in batches:
            for log_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                store, root, _ = opened(folder)
                store.create_dir(f"{root}/odd/log_id={log_id}")
                with store.open_output_stream(f"{root}/odd/log_id={log_id}/log.{suffix}", compression=None) as out:
                    out.write(encode(text.encode()))
            yield batch.select(["log_id"])

    texts.select("log_id", "text").mapInArrow(run, "log_id string").count()


def _write_codec_file(folder: str, log_id: str, piece: int, lines: list[bytes]) -> None:
    suffix, codec = (("lz4", "lz4"), ("zst", "zstd"), ("snappy", "snappy"), ("gz.1", "gzip"))[piece]
    data = b"".join(lines)
    if codec == "snappy":
        content = pa.compress(data, codec="snappy", asbytes=True)
    elif codec == "gzip":
        content = gzip.compress(data)
    else:
        # frames end anywhere, also inside a line
        content = b""
        for start in range(0, len(data), 1500):
            sink = pa.BufferOutputStream()
            with pa.CompressedOutputStream(sink, codec) as stream:
                stream.write(data[start : start + 1500])
            content += sink.getvalue().to_pybytes()
    store, root, _ = opened(folder)
    store.create_dir(f"{root}/log_id={log_id}")
    with store.open_output_stream(f"{root}/log_id={log_id}/{piece}.{suffix}", compression=None) as out:
        out.write(content)


def _write_logs(lines: DataFrame, path: str) -> None:
    # a log is a file, so one task writes it; a log holds the tasks of a bounded range of orders
    placed = lines.repartition("log_id").sortWithinPartitions("log_id", "phase", "ord", "value")
    zipped = "xxhash64(log_id) % 2 = 0"
    if files_opened(path):
        name = f"if({zipped}, concat('zipped/', {folder_of('log_id')}, '/part-0.txt.gz'), concat('plain/', {folder_of('log_id')}, '/part-0.txt'))"
        write_files(placed.selectExpr(f"{name} AS name", "value"), path, "plain", "zipped")
        return
    for name, chosen, codec in (("plain", f"NOT ({zipped})", "none"), ("zipped", zipped, "gzip")):
        part = placed.filter(chosen).select("log_id", "value")
        with shuffles_dropped(lines.sparkSession):
            part.write.partitionBy("log_id").option("compression", codec).text(f"{path}/{name}")


def files_opened(folder: str) -> bool:
    """Whether Arrow opens files there; other stores get theirs through Spark's writer, which takes longer for each."""
    try:
        opened(folder)
    except (OSError, pa.ArrowException):
        return False
    return True


def folder_of(column: str) -> str:
    """Name of the folder of a value, as Spark's writer names it. Ids hold no characters that it escapes."""
    return f"concat('{column}=', coalesce({column}, '__HIVE_DEFAULT_PARTITION__'))"


def write_files(rows: DataFrame, folder: str, *kinds: str) -> None:
    """Writes ``name, value`` rows as lines of the file of that name below ``folder``; rows of one name stand together in one task.

    Files are many and small, and Spark's writer takes several times as long for each. A task that runs again writes the same files again.
    """

    def run(batches):
        store, root, _ = opened(folder)
        current, out = None, None
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            start = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if name != current:
                    if out is not None:
                        out.close()
                    store.create_dir(f"{root}/{name.rpartition('/')[0]}")
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    if name.endswith(".gz"):
                        out = _Zipped(out)
                    current = name
                lines = batch.column(1).slice(start, end - start).to_pylist()
                out.write("".join(f"{line or ''}\n" for line in lines).encode())
                start = end
            yield pa.RecordBatch.from_arrays([runs.values], names=["name"])
        if out is not None:
            out.close()

    # a kind without files is an empty folder
    store, root, _ = opened(folder)
    for kind in kinds:
        store.create_dir(f"{root}/{kind}")
    with shuffles_dropped(rows.sparkSession):
        rows.select("name", "value").mapInArrow(run, "name string").count()


class _Zipped(gzip.GzipFile):
    """A gzip file that closes the stream below it."""

    def __init__(self, out: pa.NativeFile):
        super().__init__(fileobj=out, mode="wb", compresslevel=6, mtime=0)
        self.out = out

    def close(self) -> None:
        super().close()
        self.out.close()


# every log starts at its own time
START = "(1700000000000 + k * 1000)"
TASK_METRICS = """named_struct(
    'Executor Run Time', run_ms, 'JVM GC Time', gc_ms,
    'Disk Bytes Spilled', spill_disk_bytes, 'Memory Bytes Spilled', spill_memory_bytes,
    'Shuffle Read Metrics', named_struct('Remote Bytes Read', shuffle_read_bytes - line,
        'Local Bytes Read', line, 'Total Records Read', shuffle_read_records),
    'Shuffle Write Metrics', named_struct('Shuffle Bytes Written', shuffle_write_bytes,
        'Shuffle Records Written', shuffle_write_records),
    'Input Metrics', named_struct('Records Read', input_records),
    'Output Metrics', named_struct('Records Written', output_records))"""


def _record(event: str, **fields: str) -> str:
    """JSON line of one event; underscores in field names stand for blanks."""
    named = ", ".join(f"'{name.replace('_', ' ')}', {value}" for name, value in fields.items())
    return f"to_json(named_struct('Event', 'SparkListener{event}', {named}))"


def log_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with the log they are in."""
    return lineitem_tasks(spark, sf_dir).selectExpr("*", "concat(app_id, '_', log_no) AS log_id")


def log_lines(spark: SparkSession, sf_dir: str, chosen: str = "true") -> DataFrame:
    """Lines of all logs, or of those whose tasks are ``chosen``, as (log_id, phase, ord, value); a log's file order is phase, ord, value."""
    tasks = log_tasks(spark, sf_dir).filter(chosen)
    logs = tasks.groupBy("log_id", "k").agg(F.count("*").alias("n"))

    def emit(df: DataFrame, phase: int, value: str, ord: str = "0") -> DataFrame:
        return df.selectExpr("log_id", f"{phase} AS phase", f"bigint({ord}) AS ord", f"{value} AS value")

    # the second environment update replaces the tag and adds a key
    late = "map('spark.app.tag', 'late', 'spark.extra', log_id)"
    header = [
        emit(logs, 0, _record("LogStart", Spark_Version=pick("k % 5", *VERSIONS))),
        emit(logs, 1, _record("ApplicationStart", App_ID="log_id", App_Name="concat('job ', k)", Timestamp=START)),
        emit(logs, 2, _record("EnvironmentUpdate", Spark_Properties=supplier_config())),
        emit(logs, 3, _record("EnvironmentUpdate", Spark_Properties=late)),
        # what the reader must survive: blank, malformed and irrelevant lines
        emit(logs, 4, "'   '"),
        emit(logs, 4, """'{"Event":"SparkListenerTaskEnd","Stage ID":0,"Task Info":{"Launch Time":1'""", "1"),
        emit(logs, 4, _record("BlockUpdated", Timestamp=START), "2"),
    ]
    added = logs.selectExpr("log_id", "k", "explode(sequence(0, int(k % 7))) AS i").filter("i > 0")
    executors = emit(added, 5, _record("ExecutorAdded", Timestamp=START), "i")
    launch = 1700000000000
    info = f"named_struct('Launch Time', {launch}, 'Finish Time', {launch} + duration_ms, 'Failed', failed)"
    task_end = _record(
        "TaskEnd",
        Stage_ID="stage_id",
        Task_End_Reason="named_struct('Reason', if(killed, 'TaskKilled', 'Success'))",
        Task_Info=info,
        # the seventh task of an order lost its metrics
        Task_Metrics=f"if(line <> 7, {TASK_METRICS}, NULL)",
    )
    stages = tasks.filter(COMPLETES).groupBy("log_id", "k", "stage_id").agg(
        F.sum("input_bytes").alias("read"), F.expr("sum(output_records) * 1000 AS written")
    )

    def completed(name: str, extra: int) -> str:
        entry = "named_struct('Name', 'internal.metrics.{}', 'Value', string({}))".format
        accumulables = ", ".join(
            (entry("executorRunTime", 1), entry("input.bytesRead", "read"), entry("output.bytesWritten", "written"))
        )
        stage_info = (
            f"named_struct('Stage ID', stage_id, 'Stage Name', {name}, 'Submission Time', {START},"
            f" 'Completion Time', {START} + 1000 * (stage_id + 1) + {extra}, 'Accumulables', array({accumulables}))"
        )
        return _record("StageCompleted", Stage_Info=stage_info)

    parts = [
        *header,
        executors,
        # even stages complete twice: the second record replaces the first
        emit(stages.filter("stage_id % 2 = 0"), 7, completed("'superseded'", 500), "stage_id"),
        emit(stages, 8, completed("concat('stage ', stage_id % 4)", 0), "stage_id"),
        # a quarter of the applications was still running
        emit(logs.filter("k % 4 <> 3"), 9, _record("ApplicationEnd", Timestamp=f"{START} + 200000 + 50000 * (k % 8)")),
    ]
    lines = emit(tasks, 6, task_end)
    for part in parts:
        lines = lines.unionByName(part)
    return lines


# Payloads of applications need the suppliers only, those of their stages all tasks.
JOB_KINDS, STAGE_KINDS = (APPLICATIONS, ENVIRONMENTS, EXECUTORS), (STAGES, SUMMARIES)


def payload_root(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Saved History Server payloads written from the tables; returns the root that holds ``kind``."""

    def empty_kinds(path: str, kinds: tuple[str, ...]) -> None:
        for name in kinds:
            make_folder(spark, f"{path}/{name}")

    def write_jobs(path: str) -> None:
        _write_job_payloads(spark, sf_dir, path)
        empty_kinds(path, STAGE_KINDS)

    def write_stages(path: str) -> None:
        _write_stage_payloads(spark, sf_dir, path)
        empty_kinds(path, JOB_KINDS)

    if kind in JOB_KINDS:
        return staged_path(spark, sf_dir, "job-payloads", write_jobs)
    return staged_path(spark, sf_dir, "stage-payloads", write_stages)


@shared_plan
def job_payloads(spark: SparkSession, sf_dir: str) -> HistoryPayloads:
    """Payloads without those of stages."""
    return scan_history_json(spark, payload_root(spark, sf_dir, APPLICATIONS), multi_line=False)


@shared_plan
def stage_payloads(spark: SparkSession, sf_dir: str) -> HistoryPayloads:
    """Payloads of stages and of their tasks only."""
    return scan_history_json(spark, payload_root(spark, sf_dir, STAGES), multi_line=False)


def payloads(spark: SparkSession, sf_dir: str) -> HistoryPayloads:
    of_stages = stage_payloads(spark, sf_dir)
    return replace(job_payloads(spark, sf_dir), stages=of_stages.stages, summaries=of_stages.summaries)


def array_payloads(spark: SparkSession, sf_dir: str) -> HistoryPayloads:
    """The same payloads in the default layout: one file per application and kind, stages and executors as arrays."""

    def write(path: str) -> None:
        for kind in (APPLICATIONS, ENVIRONMENTS, STAGES, SUMMARIES, EXECUTORS):
            lines = spark.read.text(f"{payload_root(spark, sf_dir, kind)}/{kind}")
            keyed = lines.selectExpr(
                # stages are filed by application already
                "app_id" if "app_id" in lines.columns else "get_json_object(value, '$.app_id') AS app_id",
                "bigint(get_json_object(value, '$.stageId')) AS stage",
                "bigint(get_json_object(value, '$.attemptId')) AS attempt",
                "value",
            )
            # a payload is one document, as long as its application has rows
            whole = keyed.groupBy("app_id").agg(
                F.expr("concat('[', array_join(array_sort(collect_list(struct(stage, attempt, value))).value, ',\n'), ']') AS value")
            )
            _write_payload_files(whole, path, kind)

    return scan_history_json(spark, staged_path(spark, sf_dir, "array-payloads", write))


def _write_payload_files(lines: DataFrame, path: str, kind: str) -> None:
    """One file per application; the lines of each stand together."""
    if files_opened(path):
        name = f"concat({literal(kind + '/')}, {folder_of('app_id')}, '/part-0.txt')"
        write_files(lines.selectExpr(f"{name} AS name", "value"), path, kind)
    else:
        lines.select("app_id", "value").write.partitionBy("app_id").text(f"{path}/{kind}")


@shared_plan
def supplier_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with 0 to 3 attempts; those of every fifth application are unnamed."""
    attempt = (
        "named_struct('attemptId', if(k % 5 <> 0, string(i), NULL),"
        " 'startTime', concat('2024-01-0', i, 'T00:00:00.000GMT'), 'endTime', concat('2024-01-0', i, 'T01:00:00.000GMT'),"
        " 'duration', k * 1000 + i, 'sparkUser', concat('user', i), 'completed', i % 2 = 1,"
        " 'appSparkVersion', concat('3.', i, '.', k % 3), 'startTimeEpoch', k * 10 + i)"
    )
    attempts = f"transform(slice(array(1, 2, 3), 1, int(k % 4)), i -> {attempt}) AS attempts"
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_name")
    return suppliers.selectExpr("concat('app_', k) AS id", "s_name AS name", attempts, "k")


def _save_objects(kind: str, df: DataFrame, app: str, fields: str, path: str) -> None:
    """One object per line, with the application in it."""
    df.selectExpr(f"to_json(named_struct('app_id', {app}, {fields}))").write.text(f"{path}/{kind}")


def _write_job_payloads(spark: SparkSession, sf_dir: str, path: str) -> None:
    apps = supplier_applications(spark, sf_dir)
    _save_objects(APPLICATIONS, apps, "id", "'id', id, 'name', name, 'attempts', attempts", path)
    # a short pair is skipped and a repeated key takes its last value
    pairs = (
        f"concat(transform(map_entries({supplier_config()}), e -> array(e.key, e.value)),"
        " array(array('spark.only.key'), array('spark.app.tag', concat('late ', id))))"
    )
    _save_objects(ENVIRONMENTS, apps, "id", f"'sparkProperties', {pairs}", path)
    executor = (
        "'id', if(i = 0, 'driver', string(i)), 'maxMemory', k * 100 + i, 'totalDuration', k * 10 + i,"
        " 'totalGCTime', k + i, 'totalShuffleRead', k * 3 + i, 'totalShuffleWrite', k * 2 + i,"
        " 'failedTasks', k % 4 + i, 'totalCores', 4,"
        " 'peakMemoryMetrics', if(k % 2 = 0, named_struct('JVMHeapMemory', k * 50 + i), NULL)"
    )
    _save_objects(EXECUTORS, apps.selectExpr("id", "k", "explode(sequence(0, 3)) AS i"), "id", executor, path)


def _write_stage_payloads(spark: SparkSession, sf_dir: str, path: str) -> None:
    attempts = payload_stages(spark, sf_dir)
    stage = (
        "named_struct('stageId', stage_id, 'attemptId', if(attempt > 0, attempt, NULL),"
        " 'name', if(stage_id <> 6, concat('stage ', stage_id % 4), NULL), 'numTasks', task_count,"
        " 'executorRunTime', run_ms, 'jvmGcTime', gc_ms, 'shuffleReadBytes', shuffle_read_bytes,"
        " 'shuffleWriteBytes', shuffle_write_bytes,"
        " 'diskBytesSpilled', if(spill_disk_bytes > 0, spill_disk_bytes, NULL),"
        " 'numFailedTasks', failed, 'inputBytes', input_bytes)"
    )
    # the order of stages matters: one file per application, listed by attempt, then by descending stage
    lines = attempts.selectExpr("app_id", "attempt * 100 - stage_id AS ord", f"to_json({stage}) AS value")
    placed = lines.repartition("app_id").sortWithinPartitions("app_id", "ord")
    _write_payload_files(placed, path, STAGES)
    # stage 1 has no summary; stage 2 reports a short array
    summary = (
        "'stageId', stage_id, 'attemptId', attempt, 'executorRunTime', if(stage_id = 2, slice(run_q, 1, 3), run_q),"
        " 'executorCpuTime', transform(run_q, v -> v * 1000), 'inputMetrics', named_struct('bytesRead', input_q)"
    )
    _save_objects(SUMMARIES, attempts.filter("stage_id <> 1"), "app_id", summary, path)


def payload_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage attempts: a task belongs to the attempt its line number gives."""
    tasks = lineitem_tasks(spark, sf_dir).selectExpr("*", "bigint(line % 2) AS attempt")
    sums = ("run_ms", "gc_ms", "shuffle_read_bytes", "shuffle_write_bytes", "spill_disk_bytes", "input_bytes")
    fifths = "array(0D, 0.25D, 0.5D, 0.75D, 1D)"
    return tasks.groupBy("app_id", "stage_id", "attempt").agg(
        F.count("*").alias("task_count"),
        *[F.sum(c).alias(c) for c in sums],
        F.expr("count_if(failed) AS failed"),
        F.expr(f"percentile(run_ms, {fifths}) AS run_q"),
        F.expr(f"percentile(input_bytes, {fifths}) AS input_q"),
    )
