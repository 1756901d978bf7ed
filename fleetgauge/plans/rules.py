"""The rule registry and the operator that runs it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from fleetgauge.functions.config import config_accessors
from fleetgauge.plans.job_rules import JOB_RULES, job_evidence
from fleetgauge.plans.rule_model import FINDING_COLUMNS, Rule, evaluate
from fleetgauge.plans.stage_rules import STAGE_RULES
from fleetgauge.thresholds import Thresholds

CustomRule = Callable[[DataFrame, DataFrame, Thresholds], DataFrame]

BUILT_IN: dict[str, Rule] = {
    rule.rule_id: rule for rule in sorted((*STAGE_RULES, *JOB_RULES), key=lambda r: r.rule_ord)
}
_custom: dict[str, CustomRule] = {}


def register_rule(rule_id: str, rule: CustomRule) -> None:
    """Adds a rule: ``rule(stages, jobs, thresholds)`` returns rows shaped like findings."""
    if rule_id in BUILT_IN or rule_id in _custom:
        raise ValueError(f"rule {rule_id!r} exists")
    _custom[rule_id] = rule


def unregister_rule(rule_id: str) -> None:
    _custom.pop(rule_id, None)


def run_rules(
    stages: DataFrame,
    jobs: DataFrame,
    thresholds: Thresholds | None = None,
    rules: Sequence[str] | None = None,
    by: str = "app_id",
) -> DataFrame:
    """Findings of the registered rules, or of those named in ``rules``, unsorted.

    All stage rules share one scan of the stages and all job rules one row per job. ``thresholds`` and
    ``rules`` exclude each other.
    """
    if thresholds is not None and rules is not None:
        raise ValueError("give either thresholds or rules, not both")
    return evaluate_rules(stages, jobs, thresholds or Thresholds(), rules, by)


def evaluate_rules(
    stages: DataFrame, jobs: DataFrame, t: Thresholds, rules: Sequence[str] | None = None, by: str = "app_id"
) -> DataFrame:
    wanted = [*BUILT_IN, *_custom] if rules is None else list(rules)
    unknown = [rule_id for rule_id in wanted if rule_id not in BUILT_IN and rule_id not in _custom]
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    known = [BUILT_IN[r] for r in wanted if r in BUILT_IN]
    stage_rules = [r for r in known if r.per_stage]
    job_rules = [r for r in known if not r.per_stage]

    parts = []
    if stage_rules:
        aqe_flags = jobs.selectExpr(by, f"{config_accessors()['aqe_enabled']} AS aqe_enabled")
        parts.append(evaluate(stages, stage_rules, t, by, aqe_flags))
    if job_rules:
        needs_names = any(r.rule_id == "excessive_stages" for r in job_rules)
        evidence = job_evidence(stages, jobs, t, by, needs_names)
        parts.append(evaluate(evidence, job_rules, t, by))
    for rule_id in wanted:
        if rule_id in _custom:
            parts.append(_custom[rule_id](stages, jobs, t).select(by, *FINDING_COLUMNS))
    if not parts:
        raise ValueError("no rules given")
    findings = parts[0]
    for part in parts[1:]:
        findings = findings.unionByName(part)
    return findings


def order_findings(findings: DataFrame, by: str = "app_id") -> DataFrame:
    """Report order: per job, most urgent first, then registry order, then stage order.

    A range-partitioned sort on the full key, so one job's findings may span partitions.
    """
    return findings.orderBy(by, "sev_order", "rule_ord", "stage_pos")
