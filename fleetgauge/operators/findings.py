"""Operators on findings, recommendations and pairs of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import memory_utilization
from fleetgauge.functions.text import array_of, fixed, format_bytes
from fleetgauge.plans.rule_model import SEVERITIES

NOT_SET = "(not set)"


def severity_counts(findings: DataFrame, run: str = "task_id", runs: DataFrame | None = None) -> DataFrame:
    """Findings per severity of each run, as columns and as a map without zero entries.

    With ``runs`` every one of them gets a row; counts and map are null where a run has no finding.
    """
    counted = findings.groupBy(run).agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    )
    entries = F.array(*[F.struct(F.lit(s).alias("key"), F.col(s.lower()).alias("value")) for s in SEVERITIES])
    present = F.filter(entries, lambda e: e["value"] > 0)
    counted = counted.withColumn("severity_counts", F.map_from_entries(present))
    return counted if runs is None else runs.select(run).join(counted, run, "left")


def run_findings(runs: DataFrame, findings: DataFrame, task_id: str | None = None) -> DataFrame:
    """Findings of completed runs, or of one; no row means missing, not completed or clean."""
    completed = runs.filter(F.col("status") == "completed")
    if task_id is not None:
        completed = completed.filter(F.col("task_id") == task_id)
        findings = findings.filter(F.col("task_id") == task_id)
    return findings.join(completed.select("task_id"), "task_id", "left_semi")


def stage_issue_groups(findings: DataFrame, run: str = "app_id") -> DataFrame:
    """Findings grouped by the stage they concern: how many, the worst severity, the rules in report order.

    A stage has at most one finding per rule, so the gathered list is no longer than the rule list.
    """
    staged = findings.filter(F.col("stage_id").isNotNull())
    by_stage = staged.groupBy(run, "stage_id").agg(
        F.count("*").alias("issues"),
        F.min("sev_order").alias("worst"),
        F.array_sort(F.collect_list(F.struct("sev_order", "rule_ord", "rule_id"))).alias("found"),
    )
    return by_stage.select(
        run,
        "stage_id",
        "issues",
        F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("worst")).alias("worst_severity"),
        F.transform("found", lambda f: f["rule_id"]).alias("rule_ids"),
    )


def stages_with_issues(findings: DataFrame, run: str = "app_id") -> DataFrame:
    """Number of distinct stages with a finding, per run."""
    staged = findings.filter(F.col("stage_id").isNotNull())
    return staged.groupBy(run, "stage_id").agg(F.lit(1)).groupBy(run).agg(F.count("*").alias("stages"))


def suggest_config(findings: DataFrame, by: str = "app_id") -> DataFrame:
    """Findings that name both a current and a recommended value."""
    usable = (F.col("recommended_value") != "") & (F.col("current_value") != "")
    return findings.filter(usable).select(by, "rule_id", "stage_id", "current_value", "recommended_value")


def _parameter_of() -> Column:
    """Property a finding is about: the text before ``=`` in its current value, else the rule."""
    current = F.col("current_value")
    return F.when(current.contains("="), F.trim(F.split(current, "=", 2)[0])).otherwise(F.col("rule_id"))


def config_comparison(
    findings: DataFrame, suggested: DataFrame, recommendations: DataFrame, by: str = "app_id"
) -> DataFrame:
    """One entry per parameter of each run, from three sources applied in turn.

    Findings come first, then the suggested properties (which keep the current value a finding gave),
    then the recommendations. A later entry replaces an earlier one but keeps its position.
    ``suggested`` is (by, pos, parameter, recommended_value); ``recommendations`` carries ``pos``.
    """
    stage_pos = F.coalesce("stage_pos", F.lit(-1).cast("bigint"))

    def source(rank: int, positions: list[Column], df: DataFrame, parameter: Column, current: Column, origin: str):
        order = F.struct(F.lit(rank).alias("rank"), *[p.cast("bigint").alias(f"p{i}") for i, p in enumerate(positions)])
        return df.select(
            by,
            parameter.alias("parameter"),
            order.alias("at"),
            current.alias("current_value"),
            "recommended_value",
            F.lit(origin).alias("source"),
        )

    zero = F.lit(0)
    from_rules = source(
        0,
        [F.col("sev_order"), F.col("rule_ord"), stage_pos],
        findings.filter(F.col("recommended_value") != ""),
        _parameter_of(),
        F.col("current_value"),
        "rule",
    )
    from_map = source(
        1, [F.col("pos"), zero, zero], suggested, F.col("parameter"), F.lit(None).cast("string"), "ai"
    )
    from_list = source(
        2,
        [F.col("pos"), zero, zero],
        recommendations.filter(F.col("parameter") != ""),
        F.col("parameter"),
        F.coalesce("current_value", F.lit("")),
        "ai",
    )
    entries = from_rules.unionByName(from_map).unionByName(from_list)
    latest = entries.groupBy(by, "parameter").agg(
        F.max_by(F.struct("current_value", "recommended_value", "source"), "at").alias("entry"),
        F.max_by("current_value", F.when(F.col("current_value").isNotNull(), F.col("at"))).alias("known_current"),
        F.min("at").alias("first_at"),
    )
    return latest.select(
        by,
        "parameter",
        # a suggested property has no current value of its own
        F.coalesce("entry.current_value", "known_current", F.lit("")).alias("current_value"),
        "entry.recommended_value",
        "entry.source",
        "first_at",
    )


def suggested_entries(recommendations: DataFrame, by: str = "app_id") -> DataFrame:
    """Spark properties the recommendations set, one row per parameter, the last recommendation winning."""
    usable = F.col("parameter").startswith("spark.") & (F.col("recommended_value") != "")
    return (
        recommendations.filter(usable)
        .groupBy(by, "parameter")
        .agg(F.max_by("recommended_value", "pos").alias("recommended_value"), F.min("pos").alias("pos"))
    )


def suggested_config(recommendations: DataFrame, by: str = "app_id") -> DataFrame:
    """The same as one map per job; as large as the number of distinct properties recommended."""
    entries = F.map_from_entries(F.collect_list(F.struct("parameter", "recommended_value")))
    return suggested_entries(recommendations, by).groupBy(by).agg(entries.alias("suggested_config"))


# What a report line says, by column; a section leaves what it does not know empty.
REPORT_TEXTS = (
    "severity",
    "title",
    "message",
    "parameter",
    "current_value",
    "recommended_value",
    "explanation",
    "estimated_impact",
    "risk",
    "causal_chain",
)


def build_report(
    reports: DataFrame, findings: DataFrame, recommendations: DataFrame, by: str = "app_id"
) -> DataFrame:
    """Report lines of every job, flat: a header row, its findings, its recommendations, its properties.

    Within a section lines are ordered by ``sev_order``, ``rule_ord`` and ``pos``, which a section without such
    an order leaves 0. Severity is upper-cased. Rows stay flat because a job may have any number of findings.
    """
    reported = reports.select(by)

    def section(name: str, df: DataFrame, **known: str) -> DataFrame:
        texts = [f"{known.get(c, repr(''))} AS {c}" for c in REPORT_TEXTS]
        return df.selectExpr(
            by,
            f"'{name}' AS section",
            f"int({known.get('sev_order', '0')}) AS sev_order",
            f"int({known.get('rule_ord', '0')}) AS rule_ord",
            f"bigint({known.get('pos', '0')}) AS pos",
            f"bigint({known.get('stage_id', 'NULL')}) AS stage_id",
            f"bigint({known.get('priority', 'NULL')}) AS priority",
            *texts,
        )

    def same(df: DataFrame, *names: str) -> dict[str, str]:
        """Columns taken over as they are; an absent one, or a null, is an empty text."""
        return {n: f"coalesce({n}, '')" for n in names if n in df.columns}

    header = section(
        "summary", reports, severity="upper(severity)", title="summary", **same(reports, "causal_chain")
    )
    found = section(
        "finding",
        findings.join(reported, by, "left_semi"),
        **{n: n for n in ("sev_order", "rule_ord", "severity", "stage_id")},
        pos="coalesce(stage_pos, -1)",
        parameter="rule_id",
        **same(findings, "title", "message", "current_value", "recommended_value", "estimated_impact"),
    )
    advised = section(
        "recommendation",
        recommendations.join(reported, by, "left_semi"),
        pos="pos",
        **({"priority": "priority"} if "priority" in recommendations.columns else {}),
        **same(recommendations, *[c for c in REPORT_TEXTS if c not in ("severity", "message", "causal_chain")]),
    )
    properties = section(
        "property",
        suggested_entries(recommendations, by).join(reported, by, "left_semi"),
        **{n: n for n in ("pos", "parameter", "recommended_value")},
    )
    return header.unionByName(found).unionByName(advised).unionByName(properties)


def config_diff(proposed: DataFrame, jobs: DataFrame, by: str = "app_id") -> DataFrame:
    """Proposed properties (by, parameter, proposed_value) against the job's own.

    ``total_changes`` counts all proposals of the job, changed or not.
    """
    total = proposed.groupBy(by).agg(F.count("*").alias("total_changes"))
    joined = proposed.join(jobs.select(by, "config"), by).join(total, by)
    current = F.coalesce(F.try_element_at("config", F.col("parameter")), F.lit(""))
    return joined.select(
        by,
        "parameter",
        F.when(current == "", NOT_SET).otherwise(current).alias("current_value"),
        "proposed_value",
        (current != F.col("proposed_value")).alias("changed"),
        "total_changes",
    )


# Compared measures with their label, column and kind of value.
COMPARED = (
    ("Duration", "duration_ms", "ms"),
    ("Total Tasks", "total_tasks", "int"),
    ("Shuffle Read", "total_shuffle_read", "bytes"),
    ("Shuffle Write", "total_shuffle_write", "bytes"),
    ("Spill to Disk", "total_spill_disk", "bytes"),
    ("Memory Utilization", "memory_percent", "pct"),
    ("Executors", "ex_count", "int"),
)
NEED_EXECUTORS = ("memory_percent", "ex_count")
COMPARED_SUMS = {
    "total_tasks": "task_count",
    "total_shuffle_read": "shuffle_read_bytes",
    "total_shuffle_write": "shuffle_write_bytes",
    "total_spill_disk": "spill_disk_bytes",
}


def compare_jobs(stages: DataFrame, jobs: DataFrame, pairs: DataFrame, by: str = "app_id") -> DataFrame:
    """Measures of the two jobs of each pair (``app_a``, ``app_b``) side by side with their change."""
    sums = stages.groupBy(by).agg(*[F.sum(c).alias(name) for name, c in COMPARED_SUMS.items()])
    measured = jobs.join(sums, by, "left").selectExpr(
        by,
        "double(duration_ms) AS duration_ms",
        *[f"double(coalesce({name}, 0)) AS {name}" for name in COMPARED_SUMS],
        f"{memory_utilization('ex_peak_mem', 'ex_alloc_mem')} AS memory_percent",
        "double(ex_count) AS ex_count",
    )

    def side(name: str) -> DataFrame:
        columns = ", ".join(column for _, column, _ in COMPARED)
        return measured.selectExpr(f"{by} AS app_{name}", f"struct({columns}) AS {name}")

    rows = array_of(
        f"named_struct('position', {i}, 'metric', '{label}', 'kind', '{kind}', 'value_a', a.{column},"
        f" 'value_b', b.{column}, 'optional', {str(column in NEED_EXECUTORS).lower()})"
        for i, (label, column, kind) in enumerate(COMPARED)
    )
    joined = pairs.join(side("a"), "app_a").join(side("b"), "app_b")
    long = joined.selectExpr(
        "app_a", "app_b", "a.ex_count IS NOT NULL AND b.ex_count IS NOT NULL AS both", f"inline({rows})"
    ).filter("both OR NOT optional")
    described = long.selectExpr(
        *("app_a", "app_b", "position", "metric", "kind", "value_a", "value_b"),
        "value_b - value_a AS delta",
        "if(value_a = 0, NULL, (value_b - value_a) / value_a * 100) AS change_percent",
    )
    return described.selectExpr(
        *("app_a", "app_b", "position", "metric", "value_a", "value_b", "delta", "change_percent"),
        f"{_delta_text()} AS delta_text",
        f"coalesce(concat({_plus('change_percent')}, {fixed('change_percent', 1)}, '%'), 'N/A') AS change_text",
    )


def _plus(x: str) -> str:
    return f"if({x} >= 0, '+', '')"


def _delta_text() -> str:
    sign = "if(delta >= 0, '+', '-')"
    return (
        f"CASE WHEN kind = 'bytes' AND delta = 0 THEN '0 B'"
        f" WHEN kind = 'bytes' THEN concat({sign}, {format_bytes('abs(delta)')})"
        f" WHEN kind = 'ms' THEN concat({sign}, {fixed('abs(delta / 1000)', 1)}, 's')"
        f" WHEN kind = 'pct' THEN concat({_plus('delta')}, {fixed('delta', 1)}, '%')"
        f" ELSE concat({_plus('delta')}, {fixed('delta', 0)}) END"
    )
