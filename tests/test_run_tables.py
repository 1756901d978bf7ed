import json
import re

import pytest

from fleetgauge.operators import daily, run_history
from fleetgauge.sources import run_tables
from fleetgauge.sources.run_tables import RunTables, commit_runs, commits, read_documents
from pyspark.sql import functions as F
from tests.test_runs import NOW, fleet_of_runs, results_table, run, runs_table

STATISTICS = ("rule_frequency", "top_issues", "severity_trend", "stats_summary")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def reports_of(runs):
    report = "cast(struct('s' AS summary) AS struct<summary:string>)"
    full = ", ".join(f"'{f.name}', cast({'summary' if f.name == 'summary' else 'NULL'} AS {f.dataType.simpleString()})" for f in run_tables.S.REPORT.fields)
    return runs.filter("has_report").selectExpr("task_id", f"{report}.summary AS summary").selectExpr("task_id", f"named_struct({full}) AS ai_report")


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """Every run of the fixture, committed in two parts."""
    root = str(tmp_path_factory.mktemp("history"))
    runs, results = fleet_of_runs(spark)
    for even in (True, False):
        part = runs.filter((F.col("task_id").cast("int") % 2 == 0) == F.lit(even))
        assert commit_runs(part, results, root, reports=reports_of(part)) is not None
    return RunTables(spark, root), runs, results


@pytest.mark.parametrize("name", STATISTICS)
def test_partials_give_the_statistics_of_the_rows(history, name):
    tables, runs, results = history
    for days in (1, 2, 30, 60):
        assert rows(getattr(daily, name)(tables, NOW, days)) == rows(getattr(run_history, name)(runs, results, NOW, days)), days


def test_durations(history):
    tables, runs, _ = history
    assert rows(daily.duration_by_mode(tables, NOW, 30)) == rows(run_history.duration_by_mode(runs, NOW, 30))


def test_an_empty_history(spark, tmp_path):
    tables = RunTables(spark, str(tmp_path / "none"))
    assert tuple(daily.stats_summary(tables, NOW, 30).first()) == (0, 0, 0, None, None, None)
    assert daily.top_issues(tables, NOW, 30).count() == 0 and read_documents(tables, tables.runs).count() == 0


def test_a_window_opens_its_own_days(spark, tmp_path):
    root = str(tmp_path / "long")
    many = runs_table(spark, *[run(str(i), age=i + 0.5) for i in range(40)])
    found = results_table(spark, *[(str(i), "data_skew", "INFO", 1, "t") for i in range(40)])
    commit_runs(many, found, root)
    tables = RunTables(spark, root)
    plan = daily.rule_frequency(tables, NOW, 7)._jdf.queryExecution().executedPlan().toString()
    days = re.findall(r"PartitionFilters: \[isnotnull\(done#\d+\), \(done#\d+ (>|=) ([-\d]+)\)", plan)
    # a week of partials and the rows of the day it starts in: eight folders
    assert sorted(days) == [("=", "2026-03-24"), (">", "2026-03-24")]


def test_a_killed_writer_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "killed")
    runs, results = fleet_of_runs(spark)
    commit_runs(runs.filter("task_id = '1'"), results, root, name="first")
    write = run_tables._write
    for step in ("findings", "daily_findings", "daily_created"):

        def dies(df, where, table, commit, step=step):
            write(df, where, table, commit)
            if table == step:
                raise RuntimeError("killed")

        monkeypatch.setattr(run_tables, "_write", dies)
        with pytest.raises(RuntimeError):
            commit_runs(runs.filter("task_id <> '1'"), results, root, name="second")
        tables = RunTables(spark, root)
        assert [r.task_id for r in tables.runs.collect()] == ["1"] and tables.findings.count() == 2
        assert sum(r.n for r in tables.daily_findings.collect()) == 2 and commits(spark, root).count() == 1
    monkeypatch.setattr(run_tables, "_write", write)
    assert commit_runs(runs.filter("task_id <> '1'"), results, root, name="second") is not None
    assert commit_runs(runs.filter("task_id <> '1'"), results, root, name="second") is None
    tables = RunTables(spark, root)
    assert tables.runs.count() == 8 and tables.findings.count() == results.count()


def test_documents_hold_job_stages_findings_and_report(spark, tmp_path):
    runs, _ = fleet_of_runs(spark)
    # a run with many findings is one document
    found = results_table(spark, *[("1", "data_skew", "WARNING", i, f"t{i}") for i in range(3000)], ("1", "gc_pressure", "CRITICAL", 5, "first"))
    executors = ", ".join(f"'{c}', 1L" for c in run_tables.S.EXECUTOR_COLUMNS)
    job = f"named_struct('app_name', 'n', 'spark_version', '4.0', 'duration_ms', 9L, 'config', map('a', 'b'), 'executors', named_struct({executors})) AS job"
    stages = spark.range(30).selectExpr("'1' AS task_id", "id AS stage_id", "to_json(struct(id AS stage_id, 'x' AS stage_name)) AS stage")
    commit_runs(runs, found, str(tmp_path / "d"), jobs=runs.selectExpr("task_id", job), reports=reports_of(runs), stages=stages)
    tables = RunTables(spark, str(tmp_path / "d"))
    asked = spark.createDataFrame([("1",), ("2",), ("4",), ("nope",)], "task_id string")
    documents = {r.task_id: json.loads(r.result_json) for r in read_documents(tables, asked).collect()}
    assert set(documents) == {"1", "2"}
    one = documents["1"]
    assert [f["title"] for f in one["rule_results"]][:2] == ["first", "t0"] and len(one["rule_results"]) == 3001
    assert one["job"]["config"] == {"a": "b"} and one["job"]["duration_ms"] == 9 and one["ai_report"]["summary"] == "s"
    assert [s["stage_id"] for s in one["job"]["stages"]] == list(range(30))
    assert documents["2"]["rule_results"] == [] and documents["2"]["job"]["stages"] == []


def test_findings_are_folded_from_the_ends_of_their_group(spark):
    columns = "done date, completed_at timestamp, task_id string, app_id string, status string, rule_id string, severity string, title string, message string"
    rows = [
        f"('2024-01-0{1 + i % 2}', {at}, '{i}', 'app_{i % 3}', 'completed', {rule}, 'INFO', 't{i}', 'm')"
        for i, (at, rule) in enumerate(
            (f"timestamp'2024-01-0{1 + i % 2} 0{i % 7}:00:00'" if i % 5 else "NULL", "NULL" if i % 4 == 0 else f"'r{i % 2}'") for i in range(60)
        )
    ]
    names = columns.replace(" date", "").replace(" timestamp", "").replace(" string", "")
    found = spark.sql(f"SELECT date(done) AS done, timestamp(completed_at) AS completed_at, * EXCEPT (done, completed_at) FROM VALUES {', '.join(rows)} AS t({names})")
    found = found.selectExpr("*", "0 AS sev_order", "int(task_id) % 3 AS rule_ord", "bigint(NULL) AS stage_pos")
    folded, plain = daily.fold_written_findings(found), daily.fold_findings(found)
    assert rows_of(folded) == rows_of(plain) and folded.columns == plain.columns
    plan = folded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # nothing is sorted but what the join leaves
    assert 0 < plan.rindex("SortAggregate") < plan.index("BroadcastHashJoin")


def rows_of(df):
    return sorted(map(repr, df.collect()))
