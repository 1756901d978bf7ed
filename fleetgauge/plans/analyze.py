"""End-to-end static analysis: raw telemetry to metrics, findings and stored runs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.functions.text import literal
from fleetgauge.operators.events import (
    app_facts,
    config_fold,
    filter_event_types,
    parse_events,
    resolve_duration,
    stage_facts,
    task_facts,
)
from fleetgauge.operators.history_server import hs_dedup_stages, hs_job, hs_stage_metrics
from fleetgauge.operators.metrics import job_metrics, stage_metrics, stage_totals
from fleetgauge.plans.rules import evaluate_rules
from fleetgauge.schemas import EXECUTOR_COLUMNS
from fleetgauge.sources.event_logs import scan_event_log
from fleetgauge.sources.history_payloads import HistoryPayloads
from fleetgauge.sources.run_tables import commit_runs
from fleetgauge.sources.runs import result_documents
from fleetgauge.sources.staging import drop_folder, new_path, stage_table
from fleetgauge.thresholds import Thresholds


@dataclass(frozen=True)
class Fleet:
    """Metrics of many jobs. ``by`` is the column that identifies a job in both tables, ``folder`` where staged tables lie."""

    stages: DataFrame
    jobs: DataFrame
    by: str
    folder: str | None = None

    def staged(self) -> "Fleet":
        """The same tables written once. The rules read the stages three times and the jobs twice, and
        these tables are far smaller than the tasks they summarise."""
        folder = self.folder or new_path(self.stages.sparkSession, "fleet")
        stages, jobs = stage_table(self.stages, "stages", folder=folder), stage_table(self.jobs, "jobs", folder=folder)
        return Fleet(stages, jobs, self.by, folder)

    def release(self) -> None:
        """Deletes what was staged; the tables cannot be read any more."""
        if self.folder is not None:
            drop_folder(self.stages.sparkSession, self.folder)


def fold_events(lines: DataFrame, staged: bool = True) -> Fleet:
    """Log lines to stage and job metrics, keyed by log.

    The folds read the events several times, so by default the parsed events are written once, the task
    rows apart from the rest: each fold then reads only its own part and columns.
    """
    events = filter_event_types(parse_events(lines))
    folder = new_path(lines.sparkSession, "fold") if staged else None
    if staged:
        events = stage_table(events, "events", "has_task_parts", folder=folder)
    stages, tasks = stage_facts(events), task_facts(events)
    totals = stage_totals(tasks, "log_path")
    if staged:
        # stages and jobs both add up these few rows
        totals = stage_table(totals, "totals", folder=folder)
    facts = resolve_duration(app_facts(events), stages)
    return Fleet(
        stages=stage_metrics(stages, tasks, "log_path", totals=totals),
        jobs=job_metrics(facts, config_fold(events), totals, "log_path"),
        by="log_path",
        folder=folder,
    )


def fold_event_logs(spark: SparkSession, path: str, staged: bool = True) -> Fleet:
    return fold_events(scan_event_log(spark, path), staged)


def fold_history(payloads: HistoryPayloads) -> Fleet:
    """Saved History Server payloads to stage and job metrics, keyed by application."""
    stages = hs_stage_metrics(hs_dedup_stages(payloads.stages), payloads.summaries)
    jobs = hs_job(payloads.applications, payloads.environments, payloads.executors)
    return Fleet(stages=stages, jobs=jobs, by="app_id")


def analyze_jobs(fleet: Fleet, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row per finding of every job, and one with a null rule for a job without findings.

    Rows stay flat, so a job may have any number of findings.
    """
    findings = evaluate_rules(fleet.stages, fleet.jobs, thresholds, by=fleet.by)
    identity = [fleet.by] if fleet.by == "app_id" else [fleet.by, "app_id"]
    jobs = fleet.jobs.select(*identity, "app_name", "spark_version", "duration_ms")
    return jobs.join(findings, fleet.by, "left")


def record_runs(
    fleet: Fleet, now: datetime, mode: str = "static", data_source: str = "file", thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """Analyses a fleet and gives one completed run per job as storable documents (see ``sink_results``).

    Run ids are the time in nanoseconds and the job's key, so a fleet analysed twice gives two runs per job. A time without a zone
    is UTC.
    """
    return result_documents(*_runs_and_results(fleet, now, mode, data_source, thresholds))


def publish_runs(
    fleet: Fleet,
    now: datetime,
    root: str,
    mode: str = "static",
    data_source: str = "file",
    thresholds: Thresholds = Thresholds(),
    name: str | None = None,
) -> str | None:
    """As ``record_runs``, committed to the run tables under ``root`` with jobs and stages (see ``commit_runs``)."""
    runs, results = _runs_and_results(fleet, now, mode, data_source, thresholds)
    executors = ", ".join(f"'{c}', {c}" for c in EXECUTOR_COLUMNS)
    job = f"struct(app_name, spark_version, duration_ms, config, named_struct({executors}) AS executors) AS job"
    jobs = fleet.jobs.selectExpr(_task_id(fleet, now), job)
    measures = [c for c in fleet.stages.columns if c != fleet.by]
    stages = fleet.stages.selectExpr(_task_id(fleet, now), "stage_id", f"to_json(struct({', '.join(measures)})) AS stage")
    return commit_runs(runs, results, root, jobs=jobs, stages=stages, name=name)


def _task_id(fleet: Fleet, now: datetime) -> str:
    return f"concat('{round(_in_utc(now).timestamp() * 1_000_000)}000_', {fleet.by}) AS task_id"


def _in_utc(now: datetime) -> datetime:
    return now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now.astimezone(timezone.utc)


def _runs_and_results(
    fleet: Fleet, now: datetime, mode: str, data_source: str, thresholds: Thresholds
) -> tuple[DataFrame, DataFrame]:
    stamp = f"timestamp '{_in_utc(now):%Y-%m-%d %H:%M:%S.%f}+00:00'"
    runs = fleet.jobs.selectExpr(
        _task_id(fleet, now),
        "app_id",
        f"{literal(mode)} AS mode",
        f"{literal(data_source)} AS data_source",
        "'completed' AS status",
        f"{stamp} AS created_at",
        f"{stamp} AS started_at",
        f"{stamp} AS completed_at",
        "string(NULL) AS error",
    )
    findings = evaluate_rules(fleet.stages, fleet.jobs, thresholds, by=fleet.by)
    return runs, findings.selectExpr(_task_id(fleet, now), *[c for c in findings.columns if c != fleet.by])
