"""Saved History Server payloads.

Two layouts per kind. ``<root>/<kind>/app_id=<id>/<any>.json`` holds a payload exactly as the server
returned it (an object, or an array of objects); ``app_id`` comes from the folder, so reading one
application touches only its files. For whole fleets ``<root>/<kind>/<any>.json`` holds one object per
line, each with an ``app_id`` field; such files split and there are few of them. Stages keep the order of
their payload and therefore always use the first layout. Task summaries carry the stage and attempt they
were asked for as ``stageId`` and ``attemptId``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fleetgauge import schemas as S

# Payload kinds with their folder names.
APPLICATIONS, ENVIRONMENTS, STAGES, SUMMARIES, EXECUTORS = (
    "applications",
    "environment",
    "stages",
    "taskSummary",
    "executors",
)
SCHEMAS = {
    APPLICATIONS: S.APPLICATION,
    ENVIRONMENTS: S.ENVIRONMENT,
    STAGES: S.HISTORY_STAGE,
    SUMMARIES: S.TASK_SUMMARY,
    EXECUTORS: S.EXECUTOR,
}


# Position of a row in its file: the split's first byte plus the row's rank in its task. Every row takes a byte at least, so the ranks of a
# split end before the next one starts; full splits come first in their task, and only a file's last split may follow another file's.
# A file of one payload is one split.
RANK_BITS = 33  # fixed value: the bits in which monotonically_increasing_id counts the rows of a task
POSITION = f"_metadata.file_block_start + (monotonically_increasing_id() & {2**RANK_BITS - 1}) AS pos"


@dataclass(frozen=True)
class HistoryPayloads:
    applications: DataFrame
    environments: DataFrame
    stages: DataFrame
    summaries: DataFrame
    executors: DataFrame


def scan_payload(spark: SparkSession, root: str, kind: str, multi_line: bool = True) -> DataFrame:
    """Rows of one payload kind. ``multi_line=False`` reads one payload object per line."""
    schema = T.StructType([*SCHEMAS[kind].fields, T.StructField("app_id", T.StringType())])
    return spark.read.schema(schema).option("multiLine", multi_line).json(f"{root}/{kind}")


def scan_history_json(spark: SparkSession, root: str, multi_line: bool = True) -> HistoryPayloads:
    """All payload kinds under ``root``; of the stages only complete ones, with ``pos``, their order within
    the payload."""
    stages = scan_payload(spark, root, STAGES, multi_line).selectExpr("*", POSITION)
    stages = stages.filter("coalesce(status, 'COMPLETE') = 'COMPLETE'").drop("status")
    return HistoryPayloads(
        applications=scan_payload(spark, root, APPLICATIONS, multi_line),
        environments=scan_payload(spark, root, ENVIRONMENTS, multi_line),
        stages=stages,
        summaries=scan_payload(spark, root, SUMMARIES, multi_line),
        executors=scan_payload(spark, root, EXECUTORS, multi_line),
    )
