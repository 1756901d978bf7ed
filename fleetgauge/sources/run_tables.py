"""Run history as tables: runs, their stages and their findings, each filed by UTC day of completion.

A commit writes all tables under its own id and names the id in ``commits`` last, so readers see all of a commit or nothing; what a
killed writer leaves behind is never read. With the rows go *daily partials*: counts per day of completion that add up over
any days, from which the statistics of a window are sums (see ``operators.daily``).

Rows stay flat, so a run may have any number of stages and findings. A result document is put together for the runs asked for.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge import schemas as S
from fleetgauge.operators.daily import fold_created, fold_runs, fold_written_findings
from fleetgauge.session import shuffles_dropped
from fleetgauge.sources.runs import RUN_COLUMNS

_TEXTS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.FINDING.fields)
_EXECUTORS = ",".join(f"{name}:bigint" for name in S.EXECUTOR_COLUMNS)
JOB = f"struct<app_name:string,spark_version:string,duration_ms:bigint,config:map<string,string>,executors:struct<{_EXECUTORS}>>"
_WORDING = "title:string,message:string,severity:string"
_PLACE = "completed_at:timestamp,task_id:string"
# Every table with its columns; ``done`` and ``commit`` name the folder.
TABLES = {
    "runs": "task_id string, app_id string, mode string, data_source string, status string, created_at timestamp, started_at timestamp, "
    f"completed_at timestamp, error string, has_result boolean, has_report boolean, job {JOB}, ai_report {S.REPORT.simpleString()}",
    "stages": "task_id string, stage_id bigint, stage string",
    "findings": f"task_id string, app_id string, status string, completed_at timestamp, sev_order int, rule_ord int, stage_pos bigint, {_TEXTS}",
    "daily_findings": f"rule_id string, severity string, n bigint, oldest struct<{_PLACE},position:struct<a:int,b:int,c:bigint>,{_WORDING}>, "
    f"newest struct<{_PLACE},app_id:string>",
    "daily_runs": "mode string, finished bigint, timed bigint, micros bigint, with_result bigint, with_report bigint",
    "daily_created": "created date, status string, n bigint",
}
DONE = "to_date(completed_at) AS done"


@dataclass(frozen=True)
class RunTables:
    """What was committed under ``root`` when it was opened."""

    spark: SparkSession
    root: str

    def __getattr__(self, table: str) -> DataFrame:
        if table not in TABLES:
            raise AttributeError(table)
        schema = f"{TABLES[table]}, done date, commit string"
        rows = _read(self.spark, f"{self.root}/{table}", schema)
        return rows.join(commits(self.spark, self.root).select("commit"), "commit", "left_semi").drop("commit")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """``commit, name, at`` of every finished commit."""
    return _read(spark, f"{root}/commits", "commit string, name string, at timestamp")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _write(rows: DataFrame, root: str, table: str, commit: str) -> None:
    """Appends rows; a day's rows are gathered in files of the advised size, also when one day holds nearly all."""
    names = T.StructType.fromDDL(TABLES[table]).names
    typed = rows.select(*names, "done", F.lit(commit).alias("commit"))
    with shuffles_dropped(rows.sparkSession):
        typed.hint("rebalance", "done").write.mode("append").partitionBy("done", "commit").parquet(f"{root}/{table}")


def commit_runs(
    runs: DataFrame,
    results: DataFrame,
    root: str,
    jobs: DataFrame | None = None,
    reports: DataFrame | None = None,
    stages: DataFrame | None = None,
    name: str | None = None,
) -> str | None:
    """Publishes runs with their findings (``task_id`` and the finding columns) and returns the commit's id.

    ``jobs`` is (task_id, job of type ``JOB``), ``reports`` (task_id, ai_report), ``stages`` (task_id, stage_id, stage as JSON text).
    A ``name`` is committed once: repeating a commit that succeeded does nothing and returns None. Unfinished runs have no day.
    Findings of runs that are not given are left out. One writer at a time may use a name.
    """
    spark = runs.sparkSession
    if name is not None and not commits(spark, root).filter(F.col("name") == name).isEmpty():
        return None
    commit = uuid.uuid4().hex
    runs = runs.select(*RUN_COLUMNS)
    for extra, column, kind in ((jobs, "job", JOB), (reports, "ai_report", S.REPORT.simpleString())):
        if extra is None:
            runs = runs.withColumn(column, F.lit(None).cast(kind))
        else:
            runs = runs.join(extra.select("task_id", F.col(column).cast(kind).alias(column)), "task_id", "left")
    marked = runs.selectExpr("*", "status = 'completed' AS has_result", "status = 'completed' AND ai_report IS NOT NULL AS has_report", DONE)
    _write(marked, root, "runs", commit)

    # from here on the written rows are read: nothing above is computed again
    schema = f"{TABLES['runs']}, done date, commit string"
    written = spark.read.schema(schema).parquet(f"{root}/runs").filter(F.col("commit") == commit)
    of_run = written.select("task_id", "app_id", "status", "completed_at", "done")
    _write(results.drop("app_id", "status", "completed_at", "done").join(of_run, "task_id"), root, "findings", commit)
    if stages is not None:
        _write(stages.select("task_id", "stage_id", "stage").join(of_run.select("task_id", "done"), "task_id"), root, "stages", commit)
    found = spark.read.schema(f"{TABLES['findings']}, done date, commit string").parquet(f"{root}/findings")
    _write(fold_written_findings(found.filter(F.col("commit") == commit)), root, "daily_findings", commit)
    _write(fold_runs(written), root, "daily_runs", commit)
    _write(fold_created(written).withColumn("done", F.lit(None).cast("date")), root, "daily_created", commit)

    marker = spark.createDataFrame([(commit, name)], "commit string, name string").withColumn("at", F.current_timestamp())
    marker.coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return commit


def read_documents(tables: RunTables, task_ids: DataFrame) -> DataFrame:
    """``task_id, result_json`` of the completed ones among the runs asked for, with job, findings in report order, and report.

    Only these runs' stages and findings are gathered, so ask for a page of runs, not for the history.
    """
    asked = task_ids.select("task_id").distinct()
    runs = tables.runs.join(asked, "task_id", "left_semi").filter("has_result")
    texts = ", ".join(S.FINDING.names)
    in_order = f"array_sort(collect_list(struct(sev_order, rule_ord, coalesce(stage_pos, -1L) AS pos, struct({texts}) AS f)))"
    found = tables.findings.join(asked, "task_id", "left_semi").groupBy("task_id").agg(F.expr(f"{in_order}.f AS rule_results"))
    staged = tables.stages.join(asked, "task_id", "left_semi").groupBy("task_id").agg(
        F.expr("transform(array_sort(collect_list(struct(stage_id, stage))), s -> parse_json(s.stage)) AS stages")
    )
    joined = runs.join(found, "task_id", "left").join(staged, "task_id", "left")
    finding = S.FINDING.simpleString()
    return joined.selectExpr(
        "task_id",
        f"""to_json(struct(app_id, struct(app_id, job.app_name, job.spark_version, job.duration_ms, job.config,
        coalesce(stages, cast(array() AS array<variant>)) AS stages, job.executors) AS job,
        coalesce(rule_results, cast(array() AS array<{finding}>)) AS rule_results, ai_report)) AS result_json""",
    )
