"""Run status as streams: current state, feed, rates and totals.

The query logic is that of ``operators.run_state``; here it is started with the output mode it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fleetgauge.operators.run_state import label_totals, run_state, status_feed, window_rate

BatchWriter = Callable[[DataFrame, int], None]


def _start(stream: DataFrame, mode: str, write: BatchWriter, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_run_state(
    status_events: DataFrame, write: BatchWriter, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Emits the new row of every run a batch touched. State keeps one row per run."""
    return _start(run_state(status_events), "update", write, checkpoint, trigger)


def stream_status_feed(
    status_events: DataFrame,
    write: BatchWriter,
    checkpoint: str,
    task_ids: DataFrame | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Stateless feed of status changes, of all runs or of the listed ones."""
    return _start(status_feed(status_events, task_ids), "append", write, checkpoint, trigger)


def stream_window_rate(
    events: DataFrame,
    labels: list[str],
    write: BatchWriter,
    checkpoint: str,
    watermark: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Sliding rates, each window emitted once the watermark has passed it; events later than that are not counted."""
    return _start(window_rate(events, labels, watermark=watermark), "append", write, checkpoint, trigger)


def stream_label_totals(
    events: DataFrame, label: str, write: BatchWriter, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Running totals per label value; the label must have few values because all are emitted each time."""
    return _start(label_totals(events, label), "complete", write, checkpoint, trigger)
