"""Run history: reading stored results and writing new ones.

A stored run is one row with the result as a JSON document. Runs written here also carry the findings as
a typed column, so statistics read the few fields they need instead of parsing documents; runs that have
only the document are decoded. A run with very many findings is written as several *parts*, each a
complete document with a share of the findings, so that no row or task ever has to hold all findings of
a run; reading puts the parts together again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import schemas as S
from fleetgauge.functions.text import array_of, literal
from fleetgauge.plans.rule_model import SEVERITIES
from fleetgauge.session import shuffles_dropped

FINDINGS_PER_PART = 10_000
RUN_COLUMNS = (
    "task_id",
    "app_id",
    "mode",
    "data_source",
    "status",
    "created_at",
    "started_at",
    "completed_at",
    "error",
)


def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    """Stored runs with their result decoded; a null result stays null."""
    return decode_runs(spark.read.parquet(path))


def decode_runs(stored: DataFrame) -> DataFrame:
    """Adds ``rule_results`` and ``has_report`` from the document where they are not stored, and ``part``.

    Documents may be of any version: each is parsed as a variant, of which only the fields of a finding are taken. Unknown fields
    are passed over, missing ones and those of another type are null, and a damaged document is a run without a result.
    """
    if "rule_results" not in stored.columns:
        fields = ", ".join(
            f"'{f.name}', try_variant_get(v, '$.{f.name}', '{f.dataType.simpleString()}')" for f in S.FINDING.fields
        )
        parsed = stored.withColumn("document", F.expr("try_parse_json(result_json)"))
        findings = "try_variant_get(document, '$.rule_results', 'array<variant>')"
        stored = parsed.selectExpr(
            "*",
            f"transform({findings}, v -> named_struct({fields})) AS rule_results",
            "try_variant_get(document, '$.ai_report', 'map<string,variant>') IS NOT NULL AS has_report",
        ).drop("document")
    return stored if "part" in stored.columns else stored.withColumn("part", F.lit(0))


def run_rows(decoded: DataFrame) -> DataFrame:
    """One row per run with ``has_result`` and ``has_report``; later parts only repeat the run.

    The ``day`` a stored run is filed under stays, so that windows over creation times prune folders.
    """
    day = [c for c in ("day",) if c in decoded.columns]
    has_result = "rule_results IS NOT NULL AS has_result"
    return decoded.filter("part = 0").selectExpr(*RUN_COLUMNS, has_result, "has_report", *day)


def result_rows(decoded: DataFrame, rule_order: list[str]) -> DataFrame:
    """One row per finding of a run, unfolded inside the row it is stored in.

    The run's application, status and completion come along, so windows over them need no join and are
    pushed to the scan.
    """
    severities, rules = array_of(map(literal, SEVERITIES)), array_of(map(literal, rule_order))
    found = decoded.selectExpr("task_id", "app_id", "status", "completed_at", "explode(rule_results) AS f")
    return found.selectExpr(
        *("task_id", "app_id", "status", "completed_at"),
        "f.*",
        f"int(array_position({severities}, f.severity)) - 1 AS sev_order",
        f"int(array_position({rules}, f.rule_id)) - 1 AS rule_ord",
        "f.stage_id AS stage_pos",
    )


def result_documents(
    runs: DataFrame, results: DataFrame, reports: DataFrame | None = None, per_part: int = FINDINGS_PER_PART
) -> DataFrame:
    """Run rows with ``part``, ``result_json``, and the same findings typed as ``rule_results``.

    Findings are dealt to parts by hash, about ``per_part`` each, after counting them per run; within a
    part they keep report order. ``reports`` is (task_id, ai_report struct). Findings move once: they are gathered in the
    same step that brings them to their run.
    """
    texts = f"struct({', '.join(S.FINDING.names)})"
    counts = results.filter("task_id IS NOT NULL").groupBy("task_id").agg(F.expr(f"int(ceil(count(*) / {per_part})) AS parts"))
    # at most one row for every ``per_part`` findings; sent along, so that findings need not be moved to meet it
    large = F.broadcast(counts.filter("parts > 1"))
    found = results.filter("task_id IS NOT NULL").join(large, "task_id", "left").selectExpr(
        "task_id",
        "coalesce(int(pmod(xxhash64(rule_id, stage_id, message), parts)), 0) AS part",
        f"struct(sev_order, rule_ord, stage_pos, {texts} AS finding) AS placed",
    )
    if reports is None:
        reported = runs.select(*RUN_COLUMNS, F.lit(None).cast(S.REPORT).alias("ai_report"))
    else:
        reported = runs.join(reports.select("task_id", "ai_report"), "task_id", "left").select(*RUN_COLUMNS, "ai_report")
    # a run stands beside its findings in each of its parts
    asked = reported.join(large, "task_id", "left").selectExpr(
        "task_id", "explode(sequence(0, coalesce(parts, 1) - 1)) AS part", f"struct({', '.join(RUN_COLUMNS)}, ai_report) AS run"
    )
    run_type, placed_type = (df.schema[c].dataType.simpleString() for df, c in ((asked, "run"), (found, "placed")))
    rows = asked.selectExpr("task_id", "part", "run", f"cast(NULL AS {placed_type}) AS placed").unionByName(
        found.selectExpr("task_id", "part", f"cast(NULL AS {run_type}) AS run", "placed")
    )
    # dealt before they are gathered: a map task cannot combine lists, it would only sort and copy them
    gathered = rows.repartition("task_id", "part").groupBy("task_id", "part").agg(
        F.expr("collect_list(run) AS runs"),
        F.expr("array_sort(collect_list(placed)) AS placed"),
        F.expr("coalesce(bool_or(run.status = 'completed'), false) AS completed"),
    )
    # a finished run without findings has an empty first part; without an id no finding is its own
    filled = gathered.selectExpr(
        "*", "task_id IS NOT NULL AND (size(placed) > 0 OR part = 0 AND completed) AS has_result"
    )
    joined = filled.selectExpr(
        "part", "has_result", "if(has_result, placed.finding, NULL) AS rule_results", "inline(runs)"
    ).filter("has_result OR part = 0")
    joined = joined.withColumn("ai_report", F.expr("if(has_result AND part = 0, ai_report, NULL)"))
    return joined.selectExpr(
        *RUN_COLUMNS,
        "part",
        "if(has_result, to_json(struct(app_id, rule_results, ai_report)), NULL) AS result_json",
        "rule_results",
        "ai_report IS NOT NULL AS has_report",
    )


def sink_results(documents: DataFrame, path: str, file_format: str = "parquet", mode: str = "append") -> None:
    """Writes run documents filed by UTC day of creation: windows over creation times read only their days."""
    by_day = documents.withColumn("day", F.to_date("created_at"))
    with shuffles_dropped(documents.sparkSession):
        by_day.write.mode(mode).partitionBy("day").format(file_format).save(path)


def sink_properties(entries: DataFrame, path: str, by: str | None = "app_id", mode: str = "error") -> None:
    """Writes ``parameter = recommended_value`` lines; with ``by`` into one folder per job."""
    line = F.concat_ws(" = ", "parameter", "recommended_value").alias("value")
    if by is None:
        entries.select(line).write.mode(mode).text(path)
    else:
        # a job's lines are gathered, in several files where they are very many
        entries.select(by, line).hint("rebalance", by).write.mode(mode).partitionBy(by).text(path)
