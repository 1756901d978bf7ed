from fleetgauge.operators import findings as f
from fleetgauge.operators.metrics import stage_flags, stage_summary
from tables import GIB, MIB, executors, jobs, stages

FINDING = (
    "app_id string, rule_id string, severity string, sev_order int, rule_ord int, stage_id bigint, stage_pos bigint, "
    "current_value string, recommended_value string, title string"
)


def found(spark, *rows):
    return spark.createDataFrame([("a", *row, "t") for row in rows], FINDING)


def recommended(spark, *rows):
    schema = "app_id string, pos bigint, parameter string, current_value string, recommended_value string, title string"
    return spark.createDataFrame([("a", i, *row, "t") for i, row in enumerate(rows)], schema)


def test_comparison_overwrites_in_order_and_keeps_positions(spark):
    rules = found(
        spark,
        ("data_skew", "CRITICAL", 0, 0, 1, 1, "skew ratio 9x", "salt"),
        ("shuffle_partitions", "WARNING", 1, 3, None, None, "spark.sql.shuffle.partitions = 10", "spark.sql.shuffle.partitions = 90"),
        ("gc_pressure", "WARNING", 1, 2, 4, 4, "", "more memory"),
        ("quiet", "INFO", 2, 9, None, None, "x", ""),
    )
    advice = recommended(
        spark,
        ("spark.sql.shuffle.partitions", "10", "100"),
        ("spark.new", "", "1"),
        ("", "free text", "x"),
        ("spark.new", "now", "2"),
        ("layout", "", "sorted"),
        ("spark.unset", "", ""),
    )
    suggested = f.suggested_entries(advice)
    assert {r.parameter: r.recommended_value for r in suggested.collect()} == {"spark.sql.shuffle.partitions": "100", "spark.new": "2"}
    rows = f.config_comparison(rules, suggested, advice).orderBy("first_at").collect()
    assert [tuple(r)[1:5] for r in rows] == [
        ("data_skew", "skew ratio 9x", "salt", "rule"),
        ("gc_pressure", "", "more memory", "rule"),
        ("spark.sql.shuffle.partitions", "10", "100", "ai"),
        ("spark.new", "now", "2", "ai"),
        ("layout", "", "sorted", "ai"),
        ("spark.unset", "", "", "ai"),
    ]
    only_map = f.config_comparison(rules, suggested, advice.filter("false")).filter("source = 'ai'").collect()
    assert {r.parameter: r.current_value for r in only_map} == {
        "spark.sql.shuffle.partitions": "spark.sql.shuffle.partitions = 10", "spark.new": ""
    }


def test_suggest_config_needs_both_values(spark):
    rules = found(spark, ("r1", "INFO", 2, 0, 1, 1, "a", "b"), ("r2", "INFO", 2, 1, 1, 1, "", "b"), ("r3", "INFO", 2, 2, 1, 1, "a", ""))
    assert [r.rule_id for r in f.suggest_config(rules).collect()] == ["r1"]


def test_stage_groups(spark):
    rules = found(
        spark,
        ("r2", "INFO", 2, 2, 7, 7, "", ""), ("r1", "CRITICAL", 0, 1, 7, 7, "", ""), ("r1", "INFO", 2, 1, 3, 3, "", ""),
        ("job", "INFO", 2, 5, None, None, "", ""),
    )
    rows = f.stage_issue_groups(rules).orderBy("stage_id").collect()
    assert [(r.stage_id, r.issues, r.worst_severity, r.rule_ids) for r in rows] == [(3, 1, "INFO", ["r1"]), (7, 2, "CRITICAL", ["r1", "r2"])]
    assert f.stages_with_issues(rules).first().stages == 2
    assert f.severity_counts(rules, "app_id").first().severity_counts == {"CRITICAL": 1, "INFO": 3}


def test_config_diff(spark):
    proposed = spark.createDataFrame([("a", "k", "1"), ("a", "m", "2"), ("a", "n", "")], "app_id string, parameter string, proposed_value string")
    rows = f.config_diff(proposed, jobs(spark, [{"config": {"k": "1"}}])).orderBy("parameter").collect()
    assert [tuple(r)[2:] for r in rows] == [("1", "1", False, 3), ("(not set)", "2", True, 3), ("(not set)", "", False, 3)]


def test_compare_jobs(spark):
    table = stages(
        spark,
        [
            {"app_id": "a", "shuffle_read_bytes": 100 * MIB, "task_count": 10, "spill_disk_bytes": 0},
            {"app_id": "b", "shuffle_read_bytes": 50 * MIB, "task_count": 15, "spill_disk_bytes": GIB},
            {"app_id": "c"},
        ],
    )
    job_table = jobs(
        spark,
        [
            {"app_id": "a", "duration_ms": 100_000, **executors(count=10)},
            {"app_id": "b", "duration_ms": 90_500, **executors(count=8, peak=3 * GIB)},
            {"app_id": "c"},
        ],
    )
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "app_a string, app_b string")
    rows = f.compare_jobs(table, job_table, pairs).orderBy("app_b", "position").collect()
    texts = {(r.app_b, r.metric): (r.delta_text, r.change_text) for r in rows}
    assert texts["b", "Duration"] == ("-9.5s", "-9.5%")
    assert texts["b", "Total Tasks"] == ("+5", "+50.0%")
    assert texts["b", "Shuffle Read"] == ("-50.0 MB", "-50.0%")
    assert texts["b", "Shuffle Write"] == ("0 B", "+0.0%")
    assert texts["b", "Spill to Disk"] == ("+1.0 GB", "N/A")
    assert texts["b", "Memory Utilization"] == ("+25.0%", "+50.0%")
    assert texts["b", "Executors"] == ("-2", "-20.0%")
    assert ("c", "Duration") in texts and ("c", "Executors") not in texts


def test_flags_and_summary(spark):
    table = stages(
        spark,
        [
            {"run_max": 5000.0, "gc_ms": 20_000},
            {"stage_id": 1, "run_max": 5100.0, "gc_ms": 20_500, "spill_disk_bytes": 1, "failed_tasks": 2, "killed_tasks": 3},
        ],
    )
    flags = {r.stage_id: r.flags for r in stage_flags(table).collect()}
    assert flags == {0: [], 1: ["SKEW(5.1x)", "SPILL", "GC(20%)", "FAILURES(2)", "KILLED(3)"]}
    summary = stage_summary(table).filter("stage_id = 1").first()
    assert (summary.gc_percent, summary.skew_ratio, summary.has_spill, summary.has_shuffle) == (20.5, 5.1, True, True)


def test_report_keeps_every_field_in_order(spark):
    reports = spark.createDataFrame([("a", "s", "warning", "why")], "app_id string, summary string, severity string, causal_chain string")
    rules = found(spark, ("r", "INFO", 2, 1500, 3, 1, "x", "y"), ("r", "INFO", 2, 1500, 2, 2, "x", "y"))
    advice = spark.createDataFrame(
        [("a", 1, "spark.x", "1", "2", "t", "e", "i", "r", 4), ("b", 1, "spark.x", "1", "2", "t", "e", "i", "r", 4)],
        "app_id string, pos bigint, parameter string, current_value string, recommended_value string, title string,"
        " explanation string, estimated_impact string, risk string, priority bigint",
    )
    rows = f.build_report(reports, rules, advice).collect()
    lines = sorted(rows, key=lambda r: (r.section, r.sev_order, r.rule_ord, r.pos))
    assert [(r.section, r.stage_id) for r in lines] == [
        ("finding", 3), ("finding", 2), ("property", None), ("recommendation", None), ("summary", None)
    ]
    advised, header = lines[3], lines[4]
    assert (advised.priority, advised.current_value, advised.explanation, advised.estimated_impact, advised.risk) == (4, "1", "e", "i", "r")
    assert (header.severity, header.title, header.causal_chain) == ("WARNING", "s", "why")
