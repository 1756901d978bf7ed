"""Catalogue queries against their SQL on the smallest tables. ``python -m workload.compare`` runs all."""

import pytest

import __spark_entry__ as entry_module
from workload import catalog
from workload.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
SAMPLED = (
    "scan_event_log", "scan_event_log_codec", "config_fold", "task_measures", "resolve_duration", "stage_quantiles_hot",
    "stage_metrics", "job_metrics", "job_overview", "hs_stage_metrics", "hs_quantiles", "hs_job", "explain_metric",
    "config_category", "run_rules", "config_comparison", "compare_jobs", "stats_summary", "top_issues", "admit_requests",
    "run_state", "window_rate", "histogram_quantile",
)


@pytest.fixture(scope="module")
def duckdb_tables():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLED)
def test_query_agrees_with_sql(spark, duckdb_tables, name):
    assert difference(spark, duckdb_tables, FOLDER, name) is None


def test_entry_contract(spark):
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert "rule_id" in entry_module.entry(spark).columns
    assert set(catalog.QUERIES) - set(oracles) == set()


def test_stage_rules_share_one_scan(spark):
    from fleetgauge.plans.rules import evaluate_rules
    from fleetgauge.plans.stage_rules import STAGE_RULES
    from fleetgauge.thresholds import Thresholds
    from workload import adapters

    stages, jobs = adapters.fleet_stages(spark, FOLDER), adapters.fleet_jobs(spark, FOLDER)
    rules = [r.rule_id for r in STAGE_RULES if r.rule_id != "data_skew"]
    found = evaluate_rules(stages, jobs, Thresholds(), rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
