"""Admission, state and counters of runs.

All of these are plain aggregations and joins, so each works on a table and, where noted, on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetgauge.operators.run_history import TERMINAL, latest_run_per_app
from fleetgauge.functions.text import round_to

# Upper bounds in seconds of the run-duration histogram; the last bucket is open.
DURATION_BOUNDS = (1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
OPEN_BOUND = float("inf")


def admit_requests(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Decides each request (``request_id``, ``app_id``, ``rerun``) against the latest run of its application.

    ``create`` when there is none or it is over; otherwise ``conflict`` for a rerun and ``skip`` for any
    other. Requests of one batch are taken in ``request_id`` order: the first for an application that may
    run creates one, and the rest find it active.
    """
    latest = latest_run_per_app(runs).select("app_id", F.col("task_id").alias("active_task_id"), "status")
    first = requests.groupBy("app_id").agg(F.min("request_id").alias("first_request_id"))
    # both sides have one row per application, so they meet before the requests are joined
    by_app = first.join(latest, "app_id", "left")
    joined = requests.join(by_app, "app_id")
    free = F.col("status").isNull() | F.col("status").isin(*TERMINAL)
    creates = free & (F.col("request_id") == F.col("first_request_id"))
    decision = F.when(creates, "create").when(F.col("rerun"), "conflict").otherwise("skip")
    active = F.when(~free, F.col("active_task_id"))
    return joined.select("request_id", "app_id", "rerun", decision.alias("decision"), active.alias("active_task_id"))


def run_state(status_events: DataFrame) -> DataFrame:
    """Latest row per run from its append-only status log; works on tables and, in update mode, on streams.

    ``running`` sets the start, ``completed`` and ``failed`` set the end and the error. Late events still
    settle, because only stamps decide.
    """

    def last(column: str, *statuses: str) -> Column:
        return F.max_by(column, F.when(F.col("status").isin(*statuses), F.col("ts")))

    # equal stamps: the further status wins
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "running", 1).otherwise(2)
    return status_events.groupBy("task_id").agg(
        F.max("app_id").alias("app_id"),
        F.max("mode").alias("mode"),
        F.max_by("status", F.struct(F.col("ts"), rank.alias("rank"))).alias("status"),
        F.min(F.when(F.col("status") == "pending", F.col("ts"))).alias("created_at"),
        last("ts", "running").alias("started_at"),
        last("ts", *TERMINAL).alias("completed_at"),
        last("error", "failed").alias("error"),
    )


def status_feed(status_events: DataFrame, task_ids: DataFrame | None = None) -> DataFrame:
    """Status changes as they come, of all runs or of those listed; works on tables and streams."""
    feed = status_events.select("task_id", "app_id", "status", "ts", "error")
    return feed if task_ids is None else feed.join(task_ids.select("task_id"), "task_id", "left_semi")


def window_rate(
    events: DataFrame,
    labels: list[str],
    stamp: str = "ts",
    length: str = "5 minutes",
    slide: str = "1 minute",
    seconds: int = 300,
    watermark: str | None = None,
) -> DataFrame:
    """Events per second in a sliding window, per label combination.

    With ``watermark`` the input may be a stream in append mode; events later than that are not counted.
    """
    if watermark is not None:
        events = events.withWatermark(stamp, watermark)
    counts = events.groupBy(F.window(stamp, length, slide), *labels).agg(F.count("*").alias("events"))
    return counts.select(
        F.col("window.start").alias("window_start"), *labels, "events", (F.col("events") / seconds).alias("rate")
    )


def run_totals(runs: DataFrame) -> DataFrame:
    """One row: runs started, completed and failed, with success percent of the started and of all."""
    counts = runs.agg(
        F.count("*").alias("total"),
        F.count("started_at").alias("started"),
        F.expr("count_if(status = 'completed') AS completed"),
        F.expr("count_if(status = 'failed') AS failed"),
    )
    return counts.selectExpr(
        "*",
        "try_divide(completed, started) * 100 AS success_percent",
        f"{round_to('(try_divide(completed, total) * 100)', 1)} AS completed_percent",
    )


def duration_histogram(runs: DataFrame, bounds: tuple[float, ...] = DURATION_BOUNDS) -> DataFrame:
    """Cumulative run counts per mode and upper bound; one pass, the bounds are unfolded afterwards."""
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1_000_000
    timed = runs.filter((F.col("status") == "completed") & F.col("started_at").isNotNull())
    all_bounds = (*bounds, OPEN_BOUND)
    counted = timed.select("mode", seconds.alias("seconds")).groupBy("mode").agg(
        *[F.count_if(F.col("seconds") <= bound).alias(f"b{i}") for i, bound in enumerate(all_bounds)]
    )
    buckets = F.array(
        *[
            F.struct(F.lit(bound).alias("le"), F.col(f"b{i}").alias("cumulative"))
            for i, bound in enumerate(all_bounds)
        ]
    )
    return counted.select("mode", F.inline(buckets))


def histogram_quantile(histogram: DataFrame, q: float, labels: list[str] = ["mode"]) -> DataFrame:
    """Quantile estimate by linear interpolation inside the bucket holding the rank.

    In the open bucket it is the highest finite bound; an empty histogram yields no row. Windows span the
    buckets of one histogram only.
    """
    ordered = W.partitionBy(*labels).orderBy("le")
    whole = W.partitionBy(*labels)
    steps = histogram.select(
        *labels,
        "le",
        "cumulative",
        F.lag("le", 1, 0.0).over(ordered).alias("lower"),
        F.lag("cumulative", 1, 0).over(ordered).alias("below"),
        F.max("cumulative").over(whole).alias("observations"),
    ).withColumn("rank", F.col("observations") * F.lit(q))
    inside = (F.col("rank") - F.col("below")) / (F.col("cumulative") - F.col("below"))
    estimate = F.when(F.col("le") == OPEN_BOUND, F.col("lower")).when(
        F.col("cumulative") > F.col("below"), F.col("lower") + (F.col("le") - F.col("lower")) * inside
    ).otherwise(F.col("le"))
    holding = steps.filter((F.col("cumulative") >= F.col("rank")) & (F.col("observations") > 0))
    return holding.groupBy(*labels).agg(F.min_by(estimate, "le").alias("estimate"))


def label_totals(events: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """Running total per value of one label, optionally the largest few; ties in order of the label.

    Without ``limit`` it also runs on a stream in complete mode.
    """
    totals = events.groupBy(label).agg(F.count("*").alias("total"))
    return totals if limit is None else totals.orderBy(F.desc("total"), label).limit(limit)
