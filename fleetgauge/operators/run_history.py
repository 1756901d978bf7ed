"""Queries over the analysis runs.

``runs`` has one row per run; ``results`` has one row per finding of a run (``task_id`` plus the finding
columns), so a run may have any number of findings. Results that carry the run's ``app_id``, ``status``
and ``completed_at`` are filtered directly, others are joined to their runs. Relative windows end at an
explicit ``as_of`` (a timestamp, or text like ``2024-01-31 00:00:00``); times are UTC.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.text import round_to

TERMINAL = ("completed", "failed")


def since(as_of: datetime | str, days: int) -> Column:
    """Start of the window of ``days`` days ending at ``as_of``."""
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))


def _newest_first(df: DataFrame, stamp: str = "created_at") -> DataFrame:
    return df.orderBy(F.desc(stamp), F.desc("task_id"))


def _day(stamp: str) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd")


# Elapsed microseconds of a run: integers, so that sums do not depend on the order of rows.
ELAPSED = "unix_micros(completed_at) - unix_micros(started_at)"


def filter_runs(
    runs: DataFrame, status: str | None = None, app_id: str | None = None, data_source: str | None = None
) -> DataFrame:
    for column, wanted in (("status", status), ("app_id", app_id), ("data_source", data_source)):
        if wanted is not None:
            runs = runs.filter(F.col(column) == wanted)
    return runs


def list_runs(
    runs: DataFrame,
    limit: int | None = 50,
    offset: int = 0,
    status: str | None = None,
    app_id: str | None = None,
    data_source: str | None = None,
) -> DataFrame:
    """One page of runs, newest first, each row also carrying ``total``, the count before paging."""
    chosen = filter_runs(runs, status, app_id, data_source)
    total = chosen.agg(F.count("*")).scalar()
    page = _newest_first(chosen).offset(offset)
    if limit is not None:
        page = page.limit(limit)
    return page.withColumn("total", total)


def get_run(runs: DataFrame, task_id: str) -> DataFrame:
    return runs.filter(F.col("task_id") == task_id)


def latest_run_per_app(runs: DataFrame) -> DataFrame:
    """Newest run of every application; combined map-side, so a busy application is no hot spot."""
    newest = F.max_by(F.struct(*runs.columns), F.struct("created_at", "task_id"))
    return runs.groupBy("app_id").agg(newest.alias("run")).select("run.*")


def count_by_app_ids(runs: DataFrame, app_ids: DataFrame) -> DataFrame:
    """Run counts of the listed applications (column ``app_id``); applications without runs are absent.

    Counting first leaves one row per application for the join.
    """
    counts = runs.groupBy("app_id").agg(F.count("*").alias("analysis_count"))
    return counts.join(app_ids.select("app_id"), "app_id", "left_semi")


def count_by_status(runs: DataFrame, created_since: Column | None = None) -> DataFrame:
    """Runs per status, each row also carrying ``total``."""
    chosen = runs if created_since is None else runs.filter(F.col("created_at") >= created_since)
    counts = chosen.groupBy("status").agg(F.count("*").alias("count"))
    return counts.withColumn("total", counts.agg(F.sum("count")).scalar())


def completed_since(runs: DataFrame, as_of: datetime | str, days: int) -> DataFrame:
    """Completed runs that finished in the window."""
    return runs.filter((F.col("status") == "completed") & (F.col("completed_at") >= since(as_of, days)))


def created_since(runs: DataFrame, as_of: datetime | str, days: int) -> DataFrame:
    """Runs of any status created in the window; runs filed by day are read from its days only."""
    start = since(as_of, days)
    if "day" in runs.columns:
        runs = runs.filter(F.col("day") >= start.cast("date"))
    return runs.filter(F.col("created_at") >= start)


def runs_since(runs: DataFrame, as_of: datetime | str, days: int, completed: bool = False) -> DataFrame:
    """Runs of the window, newest first: by completion when ``completed``, else by creation."""
    if completed:
        return _newest_first(completed_since(runs, as_of, days), "completed_at")
    return _newest_first(created_since(runs, as_of, days))


def daily_volume(runs: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    return created_since(runs, as_of, days).groupBy(_day("created_at").alias("day")).agg(F.count("*").alias("count"))


def mode_breakdown(runs: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    return created_since(runs, as_of, days).groupBy("mode").agg(F.count("*").alias("count"))


def source_breakdown(runs: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    return created_since(runs, as_of, days).groupBy("data_source").agg(F.count("*").alias("count"))


def top_apps(runs: DataFrame, as_of: datetime | str, days: int = 30, limit: int = 10) -> DataFrame:
    """Most analysed applications; equal counts in order of the id."""
    counts = created_since(runs, as_of, days).groupBy("app_id").agg(F.count("*").alias("analysis_count"))
    return counts.orderBy(F.desc("analysis_count"), "app_id").limit(limit)


def failure_rate_trend(runs: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    """Per day of creation: all runs, failed runs, percent failed."""
    counts = created_since(runs, as_of, days).groupBy(_day("created_at").alias("day")).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    return counts.withColumn("rate", F.expr(round_to("(failed / total * 100)", 1)))


def stats_summary(runs: DataFrame, results: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    """One row: run counts by creation; mean duration, share with a report and mean findings by completion.

    The share divides runs completed in the window by completed runs created in it, so it may pass 100.
    The means are null when no completed run was created in the window. ``runs`` needs ``has_result`` and
    ``has_report``.
    """
    start = since(as_of, days)
    marked = runs.select(
        *("status", "started_at", "completed_at", "has_result", "has_report"),
        (F.col("created_at") >= start).alias("created"),
        ((F.col("status") == "completed") & (F.col("completed_at") >= start)).alias("finished"),
    ).filter("created OR finished")
    totals = marked.agg(
        F.expr("count_if(created) AS total"),
        F.expr("count_if(created AND status = 'completed') AS completed"),
        F.expr("count_if(created AND status = 'failed') AS failed"),
        F.expr(f"sum(if(finished, {ELAPSED}, NULL)) AS micros"),
        F.expr("count_if(finished AND started_at IS NOT NULL) AS timed"),
        F.expr("count_if(finished AND has_result AND has_report) AS with_report"),
        F.expr("count_if(finished AND has_result) AS with_result"),
    )
    issues = _window_findings(runs, results, as_of, days).agg(F.count("*"))
    means = totals.withColumn("issues", issues.scalar())

    def when_completed(value: str, digits: int) -> str:
        return round_to(f"if(completed > 0, {value}, NULL)", digits)

    return means.selectExpr(
        "total",
        "completed",
        "failed",
        f"{when_completed('try_divide(micros, timed) / 1000000', 2)} AS avg_duration_seconds",
        f"{when_completed('try_divide(with_report, completed) * 100', 1)} AS ai_usage_percent",
        f"{when_completed('try_divide(issues, with_result)', 1)} AS avg_issues_per_analysis",
    )


def _window_findings(runs: DataFrame, results: DataFrame, as_of: datetime | str, days: int) -> DataFrame:
    """Findings of the runs completed in the window, with ``app_id`` and ``completed_at`` of the run."""
    if {"app_id", "status", "completed_at"} <= set(results.columns):
        return completed_since(results, as_of, days)
    finished = completed_since(runs, as_of, days).select("task_id", "app_id", "completed_at")
    return results.join(finished, "task_id")


def _oldest() -> Column:
    """Order whose minimum is the last finding met when runs are read newest first."""
    position = F.struct(-F.col("sev_order"), -F.col("rule_ord"), -F.coalesce("stage_pos", F.lit(-1).cast("bigint")))
    return F.struct("completed_at", "task_id", position)


def rule_frequency(runs: DataFrame, results: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    """Findings per rule in the window; title and severity are those of its oldest run."""
    found = _window_findings(runs, results, as_of, days)
    meta = F.min_by(F.struct("title", "severity"), _oldest())
    counts = found.groupBy("rule_id").agg(F.count("*").alias("count"), meta.alias("meta"))
    return counts.select("rule_id", "meta.title", "count", "meta.severity")


def top_issues(
    runs: DataFrame, results: DataFrame, as_of: datetime | str, days: int = 30, limit: int = 10
) -> DataFrame:
    """Most frequent rules with wording from the oldest run and the newest run's application as example."""
    found = _window_findings(runs, results, as_of, days)
    meta = F.min_by(F.struct("title", "message", "severity"), _oldest())
    example = F.max_by("app_id", F.struct("completed_at", "task_id"))
    counts = found.groupBy("rule_id").agg(
        F.count("*").alias("count"), meta.alias("meta"), example.alias("example_app_id")
    )
    flat = counts.select("rule_id", "meta.title", "meta.message", "count", "meta.severity", "example_app_id")
    return flat.orderBy(F.desc("count"), "rule_id").limit(limit)


def severity_trend(runs: DataFrame, results: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    """Findings per severity and day of completion; a day with clean runs only shows zeros.

    Days meet days: both sides are reduced to one row per day before the join.
    """
    day = _day("completed_at").alias("day")
    all_days = completed_since(runs, as_of, days).filter("has_result").select(day).distinct()
    counts = _window_findings(runs, results, as_of, days).groupBy(day).agg(
        F.expr("count_if(severity = 'CRITICAL') AS critical"),
        F.expr("count_if(severity = 'WARNING') AS warning"),
        F.expr("count_if(severity = 'INFO') AS info"),
    )
    return all_days.join(counts, "day", "left").fillna(0, ["critical", "warning", "info"])


def duration_by_mode(runs: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    """Mean seconds and number of completed runs with both stamps, per mode."""
    timed = completed_since(runs, as_of, days).filter(F.col("started_at").isNotNull())
    sums = timed.groupBy("mode").agg(F.expr(f"sum({ELAPSED}) AS micros"), F.count("*").alias("count"))
    mean = round_to("(micros / count / 1000000)", 2)
    return sums.selectExpr("mode", f"{mean} AS avg_duration_seconds", "count")


def group_runs_by_app(page: DataFrame) -> DataFrame:
    """Runs of one page gathered per application, newest first, applications by their newest run.

    A page is bounded by its limit, so the gathered lists are too.
    """
    entry = F.struct((-F.unix_micros("created_at")).alias("age"), "task_id", "status")
    grouped = page.groupBy("app_id").agg(
        F.count("*").alias("runs"),
        F.max(F.struct("created_at", "task_id")).alias("newest"),
        F.array_sort(F.collect_list(entry), _by_age).alias("entries"),
    )
    return grouped.select(
        "app_id",
        "runs",
        F.col("newest.task_id").alias("newest_task_id"),
        F.transform("entries", lambda e: e["task_id"]).alias("task_ids"),
    )


def _by_age(a: Column, b: Column) -> Column:
    """Newest first, then by descending id."""
    older = (a["age"] > b["age"]) | ((a["age"] == b["age"]) & (a["task_id"] < b["task_id"]))
    newer = (a["age"] < b["age"]) | ((a["age"] == b["age"]) & (a["task_id"] > b["task_id"]))
    return F.when(newer, -1).when(older, 1).otherwise(0)


def list_applications(
    applications: DataFrame, runs: DataFrame, newest: str, limit: int = 20, offset: int = 0
) -> DataFrame:
    """A page of applications with the fields of their latest attempt and their number of runs.

    ``newest`` is the column that orders applications, highest first. ``fetched`` counts the applications
    read for the page: at most offset + limit, not all there are.
    """
    fetched = applications.limit(offset + limit)
    page = applications.orderBy(F.desc(newest), F.desc("id")).offset(offset).limit(limit)
    counts = count_by_app_ids(runs, page.select(F.col("id").alias("app_id")))
    latest = F.try_element_at("attempts", F.lit(-1))
    none = F.lit("")
    return page.join(counts, page["id"] == counts["app_id"], "left").select(
        "id",
        F.coalesce("name", none).alias("name"),
        F.coalesce(latest["startTime"], none).alias("start_time"),
        F.coalesce(latest["endTime"], none).alias("end_time"),
        F.coalesce(latest["duration"], F.lit(0).cast("bigint")).alias("duration_ms"),
        F.coalesce(latest["completed"], F.lit(False)).alias("completed"),
        F.coalesce(latest["appSparkVersion"], none).alias("spark_version"),
        F.coalesce(latest["sparkUser"], none).alias("user"),
        F.coalesce("analysis_count", F.lit(0).cast("bigint")).alias("analysis_count"),
        fetched.agg(F.count("*")).scalar().alias("fetched"),
    )


def search_applications(applications: DataFrame, text: str) -> DataFrame:
    """Applications whose id or name contains the text, ignoring case."""
    wanted = F.lit(text.lower())
    return applications.filter(F.lower("id").contains(wanted) | F.lower("name").contains(wanted))
