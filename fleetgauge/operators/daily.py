"""Statistics of a window as sums of daily partials.

A partial holds one day of completion (of creation for ``fold_created``); partials of any days and commits merge by sums, minima and
maxima. A window of days starts within a day: that day is folded from its rows, all later ones are read as partials. So a window opens
the folders of its own days only, and rows of one of them. ``tables`` has the tables of ``sources.run_tables``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.text import round_to
from fleetgauge.operators.run_history import ELAPSED, since

COMPLETED = "status = 'completed'"


FINDING_KEYS = ("done", "rule_id", "severity")
_POSITION = "struct(-sev_order AS a, -rule_ord AS b, -coalesce(stage_pos, -1L) AS c) AS position"


def finding_ends() -> list[Column]:
    return [
        F.expr(f"min(struct(completed_at, task_id, {_POSITION}, title, message, severity)) AS oldest"),
        F.expr("max(struct(completed_at, task_id, app_id)) AS newest"),
    ]


def fold_findings(findings: DataFrame) -> DataFrame:
    """Findings of completed runs per day, rule and severity; ``oldest`` starts with the order in which the last finding met counts."""
    return findings.filter(COMPLETED).groupBy(*FINDING_KEYS).agg(F.expr("count(*) AS n"), *finding_ends())


def fold_written_findings(findings: DataFrame) -> DataFrame:
    """As ``fold_findings``, for a written table of many days, which is read twice.

    Least and greatest texts need a sort, so they are looked for only among the findings at the first and at the last moment of
    their group. The groups are broadcast: one row for every day, rule and severity.
    """
    found = findings.filter(COMPLETED)
    groups = found.groupBy(*FINDING_KEYS).agg(
        F.expr("count(*) AS n"),
        # an unknown moment comes before all others
        F.expr("if(count(completed_at) < count(*), NULL, min(completed_at)) AS first"),
        F.expr("max(completed_at) AS last"),
    )
    ends = groups.selectExpr(*(f"{c} AS of_{c}" for c in FINDING_KEYS), "n", "first", "last")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in FINDING_KEYS]
    at_end = F.col("completed_at").eqNullSafe(F.col("first")) | F.col("completed_at").eqNullSafe(F.col("last"))
    edge = found.join(F.broadcast(ends), [*same, at_end])
    return edge.groupBy(*FINDING_KEYS).agg(F.expr("max(n) AS n"), *finding_ends())


def fold_runs(runs: DataFrame) -> DataFrame:
    """Completed runs per day and mode."""
    return runs.filter(COMPLETED).groupBy("done", "mode").agg(
        F.expr("count(*) AS finished"),
        F.expr("count(started_at) AS timed"),
        F.expr(f"sum({ELAPSED}) AS micros"),
        F.expr("count_if(has_result) AS with_result"),
        F.expr("count_if(has_result AND has_report) AS with_report"),
    )


def fold_created(runs: DataFrame) -> DataFrame:
    """Runs per day of creation and status."""
    return runs.groupBy(F.to_date("created_at").alias("created"), "status").agg(F.expr("count(*) AS n"))


def _first_day(as_of: datetime | str, days: int) -> tuple[Column, Column]:
    start = since(as_of, days)
    return start, F.to_date(start)


def window_findings(tables, as_of: datetime | str, days: int) -> DataFrame:
    """Partials of the findings whose run was completed in the window."""
    start, first = _first_day(as_of, days)
    edge = tables.findings.filter((F.col("done") == first) & (F.col("completed_at") >= start))
    return tables.daily_findings.filter(F.col("done") > first).unionByName(fold_findings(edge))


def window_runs(tables, as_of: datetime | str, days: int) -> DataFrame:
    """Partials of the runs completed in the window."""
    start, first = _first_day(as_of, days)
    edge = tables.runs.filter((F.col("done") == first) & (F.col("completed_at") >= start))
    return tables.daily_runs.filter(F.col("done") > first).unionByName(fold_runs(edge))


def window_created(tables, as_of: datetime | str, days: int) -> DataFrame:
    """Partials of the runs created in the window; a run is completed on its day of creation or later, or not at all."""
    start, first = _first_day(as_of, days)
    edge = tables.runs.filter(F.col("done").isNull() | (F.col("done") >= first))
    edge = edge.filter((F.col("created_at") >= start) & (F.to_date("created_at") == first))
    whole = tables.daily_created.filter(F.col("created") > first).drop("done")
    return whole.unionByName(fold_created(edge))


def rule_frequency(tables, as_of: datetime | str, days: int = 30) -> DataFrame:
    """As ``run_history.rule_frequency``."""
    merged = window_findings(tables, as_of, days).groupBy("rule_id").agg(F.sum("n").alias("count"), F.min("oldest").alias("m"))
    return merged.select("rule_id", "m.title", "count", "m.severity")


def top_issues(tables, as_of: datetime | str, days: int = 30, limit: int = 10) -> DataFrame:
    """As ``run_history.top_issues``."""
    merged = window_findings(tables, as_of, days).groupBy("rule_id").agg(
        F.sum("n").alias("count"), F.min("oldest").alias("m"), F.max("newest").alias("e")
    )
    flat = merged.select("rule_id", "m.title", "m.message", "count", "m.severity", F.col("e.app_id").alias("example_app_id"))
    return flat.orderBy(F.desc("count"), "rule_id").limit(limit)


def severity_trend(tables, as_of: datetime | str, days: int = 30) -> DataFrame:
    """As ``run_history.severity_trend``."""
    counts = window_findings(tables, as_of, days).groupBy("done").agg(
        *[F.expr(f"sum(if(severity = '{s}', n, 0L)) AS {s.lower()}") for s in ("CRITICAL", "WARNING", "INFO")]
    )
    seen = window_runs(tables, as_of, days).filter("with_result > 0").select("done").distinct()
    joined = seen.join(counts, "done", "left").fillna(0, ["critical", "warning", "info"])
    return joined.select(F.date_format("done", "yyyy-MM-dd").alias("day"), "critical", "warning", "info")


def duration_by_mode(tables, as_of: datetime | str, days: int = 30) -> DataFrame:
    """As ``run_history.duration_by_mode``."""
    sums = window_runs(tables, as_of, days).groupBy("mode").agg(F.sum("micros").alias("micros"), F.sum("timed").alias("count"))
    return sums.filter("count > 0").selectExpr("mode", f"{round_to('(micros / count / 1000000)', 2)} AS avg_duration_seconds", "count")


def stats_summary(tables, as_of: datetime | str, days: int = 30) -> DataFrame:
    """As ``run_history.stats_summary``: one row."""
    created = window_created(tables, as_of, days).agg(
        F.expr("coalesce(sum(n), 0L) AS total"),
        F.expr("coalesce(sum(if(status = 'completed', n, 0L)), 0L) AS completed"),
        F.expr("coalesce(sum(if(status = 'failed', n, 0L)), 0L) AS failed"),
    )
    finished = window_runs(tables, as_of, days).agg(*[F.expr(f"sum({c}) AS {c}") for c in ("micros", "timed", "with_result", "with_report")])
    issues = window_findings(tables, as_of, days).agg(F.expr("coalesce(sum(n), 0L)"))
    # scalars of one-row tables
    one = created.withColumn("issues", issues.scalar())
    for c in ("micros", "timed", "with_result", "with_report"):
        one = one.withColumn(c, finished.select(c).scalar())

    def when_completed(value: str, digits: int) -> str:
        return round_to(f"if(completed > 0, {value}, NULL)", digits)

    return one.selectExpr(
        "total",
        "completed",
        "failed",
        f"{when_completed('try_divide(micros, timed) / 1000000', 2)} AS avg_duration_seconds",
        f"{when_completed('try_divide(with_report, completed) * 100', 1)} AS ai_usage_percent",
        f"{when_completed('try_divide(issues, with_result)', 1)} AS avg_issues_per_analysis",
    )
