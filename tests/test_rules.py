import pytest

from fleetgauge.plans import rules
from fleetgauge.plans.rules import evaluate_rules, order_findings, register_rule, run_rules, unregister_rule
from fleetgauge.thresholds import Thresholds
from tables import GIB, MIB, executors, jobs, stages

KRYO = {"spark.serializer": "org.apache.spark.serializer.KryoSerializer"}


def severities(spark, rule, stage_rows=None, job_rows=None, t=Thresholds()):
    """Severity per case: every case is an application of its own."""
    stage_rows = stage_rows if stage_rows is not None else [{} for _ in job_rows]
    job_rows = job_rows if job_rows is not None else [{} for _ in stage_rows]
    placed = []
    for i, row in enumerate(stage_rows):
        placed += [{**r, "app_id": str(i)} for r in (row if isinstance(row, list) else [row])]
    jobs_table = jobs(spark, [{**row, "app_id": str(i)} for i, row in enumerate(job_rows)])
    found = evaluate_rules(stages(spark, placed), jobs_table, t, [rule]).collect()
    by_app = {}
    for f in found:
        assert f.rule_id == rule
        by_app.setdefault(int(f.app_id), []).append(f)
    assert all(len(fs) == 1 for fs in by_app.values())
    return [by_app[i][0].severity if i in by_app else None for i in range(len(job_rows))], by_app


def test_data_skew(spark):
    cases = [
        {"run_max": 4999.0}, {"run_max": 5000.0}, {"run_max": 10000.0}, {"run_max": 10001.0},
        {"run_max": 90000.0, "task_count": 9}, {"run_max": 9000.0, "run_median": 0.0}, {"run_max": 9000.0},
    ]
    aqe = [{}] * 6 + [{"config": {"spark.sql.adaptive.enabled": "true"}}]
    got, found = severities(spark, "data_skew", cases, aqe)
    assert got == [None, "WARNING", "WARNING", "CRITICAL", None, None, "WARNING"]
    f = found[1][0]
    assert f.title == "Data skew in Stage 0"
    assert f.message == "Max task duration (5000.0ms) is 5.0x the median (1000.0ms)"
    assert f.current_value == "skew ratio 5.0x" and f.estimated_impact == "Stage 0 duration could decrease ~80%"
    assert f.recommended_value.startswith("Enable AQE")
    assert found[6][0].recommended_value.startswith("AQE is enabled but skew persists")


def test_spill_to_disk(spark):
    cases = [
        {}, {"spill_disk_bytes": 1, "input_bytes": 0}, {"spill_disk_bytes": GIB // 2, "input_bytes": 0},
        {"spill_disk_bytes": GIB, "input_bytes": 0}, {"spill_disk_bytes": GIB + 1, "input_bytes": 0},
        {"spill_disk_bytes": 2 * GIB, "input_bytes": 201 * GIB}, {"spill_disk_bytes": 2 * GIB, "input_bytes": 200 * GIB},
    ]
    got, found = severities(spark, "spill_to_disk", cases)
    assert got == [None, "INFO", "WARNING", "WARNING", "CRITICAL", "INFO", "CRITICAL"]
    assert found[2][0].message == "0.5 GB spilled to disk — data doesn't fit in memory"


def test_gc_pressure(spark):
    cases = [
        {"gc_ms": 19_999}, {"gc_ms": 20_000}, {"gc_ms": 40_000}, {"gc_ms": 40_001},
        {"gc_ms": 50_000, "sum_run_ms": 59_999}, {"gc_ms": 30_000, "sum_run_ms": 60_000}, {"gc_ms": 0, "sum_run_ms": 0},
    ]
    got, found = severities(spark, "gc_pressure", cases)
    assert got == [None, "WARNING", "WARNING", "CRITICAL", None, "CRITICAL", None]
    assert found[1][0].estimated_impact == "Reducing GC to <10% could save ~10% stage time"


def test_shuffle_partitions(spark):
    def sized(gib):
        return [{"shuffle_read_bytes": 1}, {"shuffle_read_bytes": gib * GIB, "stage_id": 1}]

    parts = "spark.sql.shuffle.partitions"
    on = {"spark.sql.adaptive.enabled": "true"}
    stage_rows = [sized(100), sized(100), sized(100), sized(10), sized(10), {"shuffle_read_bytes": 0}, sized(100)]
    job_rows = [
        {"config": {}},
        {"config": {parts: "400"}},
        {"config": on, "spark_version": "3.2.0"},
        {"config": {parts: "240"}},
        {"config": {parts: "241"}},
        {"config": {}},
        {"config": on, "spark_version": "3.1.9"},
    ]
    got, found = severities(spark, "shuffle_partitions", stage_rows, job_rows)
    assert got == ["WARNING", None, None, None, "INFO", None, "INFO"]
    assert found[0][0].message == "Too few partitions: 200 for 100.0 GB shuffle"
    assert found[0][0].recommended_value == "spark.sql.shuffle.partitions = 800"
    assert found[6][0].message.endswith("(AQE may handle partition coalescing automatically)")


def test_executor_idle(spark):
    cores = {"spark.executor.cores": "1"}

    def job(task_ms, **more):
        return {"duration_ms": 300_000, "config": cores, **executors(count=10, task_ms=task_ms), **more}

    full = 3_000_000
    da = {**cores, "spark.dynamicAllocation.enabled": "true"}
    job_rows = [
        job(full * 41 // 100), job(full * 40 // 100), job(full * 20 // 100), job(full * 19 // 100),
        job(full * 19 // 100, config=da), job(full * 30 // 100, config=da), job(0, duration_ms=299_999),
        {"config": cores}, job(0, ex_count=0),
    ]
    got, found = severities(spark, "executor_idle", job_rows=job_rows)
    assert got == [None, "WARNING", "WARNING", "CRITICAL", "WARNING", "INFO", None, None, None]
    assert found[1][0].current_value == "10 executors x 1 cores, 40% utilized"
    assert found[1][0].message == "Slot utilization is only 40% — 60% idle"


def test_task_failures(spark):
    got, found = severities(spark, "task_failures", [{}, {"failed_tasks": 1}, {"failed_tasks": 9}, {"failed_tasks": 10}])
    assert got == [None, "WARNING", "WARNING", "CRITICAL"]
    assert found[1][0].message == "1 of 100 tasks failed" and found[1][0].estimated_impact == ""


def test_small_files(spark):
    cases = [
        {"in_median": 10.0 * MIB}, {"in_median": 10.0 * MIB - 1}, {"in_median": 1.0 * MIB}, {"in_median": 1.0 * MIB - 1},
        {"input_bytes": 500 * MIB, "shuffle_read_bytes": 0}, {"input_bytes": 50 * MIB, "shuffle_read_bytes": 0},
        {"input_bytes": 0}, {"input_bytes": 0, "shuffle_read_bytes": 0}, {"input_bytes": 100, "task_count": 0},
    ]
    got, found = severities(spark, "small_files", cases)
    assert got == [None, "WARNING", "WARNING", "CRITICAL", "WARNING", "CRITICAL", None, None, None]
    assert found[4][0].current_value == "5.0 MB/task, 100 tasks"


def test_broadcast_join(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    on = {"spark.sql.adaptive.enabled": "true"}
    no_shuffle = {"shuffle_read_bytes": 0}
    stage_rows = [{}, {}, no_shuffle, {}, {}, no_shuffle]
    configs = [{key: "-1"}, {key: "-1", **on}, {key: "-1"}, {key: "1048576"}, {key: "10485760"}, {key: "1048576"}]
    got, found = severities(spark, "broadcast_join", stage_rows, [{"config": c} for c in configs])
    assert got == ["WARNING", "INFO", "INFO", "INFO", None, None]
    assert found[0][0].recommended_value == "spark.sql.autoBroadcastJoinThreshold = 10485760"
    assert found[3][0].current_value == "1 MB" and found[3][0].recommended_value.endswith("= 10485760 (10 MB)")


def test_serializer_choice(spark):
    nothing = {"shuffle_read_bytes": 0, "shuffle_write_bytes": 0}
    got, _ = severities(
        spark,
        "serializer_choice",
        [{}, {}, nothing, {**nothing, "shuffle_write_bytes": 1}],
        [{}, {"config": KRYO}, {}, {}],
    )
    assert got == ["INFO", None, None, "INFO"]


def test_dynamic_allocation(spark):
    on = {"spark.dynamicAllocation.enabled": "true"}
    low, high = {"spark.dynamicAllocation.minExecutors": "1"}, {"spark.dynamicAllocation.maxExecutors": "9"}
    idle = executors(count=10, task_ms=1000)
    job_rows = [{"config": on}, {"config": {**on, **low}}, {"config": {**on, **low, **high}}, {}, idle, {**idle, "config": on}]
    got, found = severities(spark, "dynamic_allocation", job_rows=job_rows)
    assert got == ["WARNING", "WARNING", None, None, "INFO", "WARNING"]
    assert found[0][0].message == "Dynamic allocation enabled but minExecutors, maxExecutors not set"
    assert found[0][0].recommended_value == (
        "spark.dynamicAllocation.minExecutors = <value>, spark.dynamicAllocation.maxExecutors = <value>"
    )
    assert found[1][0].recommended_value == "spark.dynamicAllocation.maxExecutors = <value>"
    assert found[4][0].current_value == "10 static executors, 0% utilized"


def test_executor_memory_overhead(spark):
    hot = {"gc_ms": 25_000}
    tight = executors(peak=80, allocated=100)
    stage_rows = [hot, hot, {"gc_ms": 20_000}, [hot, {"gc_ms": 900, "sum_run_ms": 1000, "stage_id": 1}], hot]
    job_rows = [tight, executors(peak=79, allocated=100), tight, tight, {}]
    got, found = severities(spark, "executor_memory_overhead", stage_rows, job_rows)
    assert got == ["WARNING", None, None, "WARNING", None]
    assert found[0][0].message == "High GC (25% in hottest stage) with 80% memory utilization"
    assert found[0][0].current_value == "memoryOverhead = default (max(384MB, 10%))"
    assert found[3][0].value == pytest.approx(90)


def test_driver_memory(spark):
    def job(memory, **more):
        return {"config": {"spark.driver.memory": memory}, **more}

    job_rows = [
        job("511m"), job("512m"), job("1g", **executors(count=50)), job("1g", **executors(count=51)),
        job("2g", **executors(count=51)), job("16g"), job("17g"), job("junk"), {},
    ]
    got, found = severities(spark, "driver_memory", job_rows=job_rows)
    assert got == ["WARNING", None, None, "WARNING", None, None, "INFO", None, None]
    assert found[0][0].message == "Driver memory is too low: 511m (511 MB) — risk of OOM"
    assert found[3][0].recommended_value == "spark.driver.memory >= 2048m"


def test_memory_underutilization(spark):
    loose = executors(peak=39, allocated=100)
    stage_rows = [{}, {}, {"spill_disk_bytes": 1}, {"gc_ms": 20_001}, {"gc_ms": 900, "sum_run_ms": 1000}, {}, {}]
    job_rows = [loose, executors(peak=40, allocated=100), loose, loose, loose, executors(peak=0, allocated=100), {}]
    got, _ = severities(spark, "memory_underutilization", stage_rows, job_rows)
    assert got == ["WARNING", None, None, None, "WARNING", None, None]


def test_aqe_not_enabled(spark):
    off, on = {"spark.sql.adaptive.enabled": "false"}, {"spark.sql.adaptive.enabled": "true"}
    job_rows = [
        {"spark_version": "3.2.0", "config": off}, {"spark_version": "3.2.0"}, {"spark_version": "3.1.2"},
        {"spark_version": "3.0.0", "config": on}, {"spark_version": "2.4.8"}, {"spark_version": ""},
    ]
    got, found = severities(spark, "aqe_not_enabled", job_rows=job_rows)
    assert got == ["WARNING", None, "INFO", None, None, None]
    assert found[0][0].title == "AQE explicitly disabled" and found[2][0].title == "AQE not enabled"


def test_excessive_stages(spark):
    def named(distinct):
        return [{"stage_id": i, "stage_name": f"n{i % distinct}"} for i in range(2 * distinct)]

    got, found = severities(spark, "excessive_stages", [named(4), named(5), [{"stage_id": i, "stage_name": str(i)} for i in range(12)]])
    assert got == [None, "WARNING", None]
    assert found[1][0].message.startswith("Stages re-executed: ['n0', 'n1', 'n2', 'n3', 'n4'] — add .persist()")


def test_shuffle_data_volume(spark):
    cases = [
        {"input_bytes": 100, "shuffle_write_bytes": 300}, {"input_bytes": 100, "shuffle_write_bytes": 301},
        {"input_bytes": 0, "shuffle_write_bytes": 50 * GIB}, {"input_bytes": 0, "shuffle_write_bytes": 51 * GIB},
        {"input_bytes": 51 * GIB, "shuffle_write_bytes": 51 * GIB}, {"input_bytes": GIB, "shuffle_write_bytes": 60 * GIB},
    ]
    got, found = severities(spark, "shuffle_data_volume", cases)
    assert got == [None, "WARNING", None, "WARNING", "WARNING", "WARNING"]
    assert found[3][0].current_value == "51.0 GB shuffle write"
    assert found[5][0].current_value == "60.0 GB shuffle write, 60.0x input ratio"


def test_input_data_skew(spark):
    cases = [
        {"in_median": 100.0, "in_max": 499.0}, {"in_median": 100.0, "in_max": 500.0}, {"in_median": 100.0, "in_max": 1000.0},
        {"in_median": 0.0, "in_max": 1000.0}, {"in_median": 1.0, "in_max": 1000.0, "task_count": 9},
        {"in_median": 1.0, "in_max": 1000.0, "input_bytes": 0},
    ]
    got, found = severities(spark, "input_data_skew", cases)
    assert got == [None, "WARNING", "CRITICAL", None, None, None]
    assert found[2][0].message == "Max task input (1000.0 B) is 10.0x the median (100.0 B)"
    assert found[2][0].estimated_impact == "Stage 0 tasks could run ~90% faster"


def test_report_order_and_missing_jobs(spark):
    table = stages(
        spark,
        [
            {"stage_id": 2, "failed_tasks": 1, "gc_ms": 30_000},
            {"stage_id": 1, "failed_tasks": 20, "gc_ms": 30_000, "run_max": 60_000.0},
        ],
    )
    found = order_findings(run_rules(table, jobs(spark, [{"config": KRYO}]))).collect()
    order = [(f.severity, f.rule_id, f.stage_id) for f in found]
    assert order == [
        ("CRITICAL", "data_skew", 1),
        ("CRITICAL", "task_failures", 1),
        ("WARNING", "gc_pressure", 1),
        ("WARNING", "gc_pressure", 2),
        ("WARNING", "task_failures", 2),
        ("INFO", "shuffle_partitions", None),
    ]


def test_healthy_job_has_no_findings(spark):
    config = {**KRYO, "spark.sql.shuffle.partitions": "1"}
    assert run_rules(stages(spark, [{}]), jobs(spark, [{"config": config}])).count() == 0


def test_custom_rules_and_rule_lists(spark):
    def many_stages(stage_table, job_table, t):
        counts = stage_table.groupBy("app_id").count().filter("count > 1")
        return counts.selectExpr(
            "app_id", "'many_stages' AS rule_id", "'INFO' AS severity", "2 AS sev_order", "99 AS rule_ord",
            "bigint(NULL) AS stage_id", "bigint(NULL) AS stage_pos", "double(count) AS value", "'Many stages' AS title",
            "'' AS message", "'' AS current_value", "'' AS recommended_value", "'' AS estimated_impact",
        )

    table, job_table = stages(spark, [{"failed_tasks": 1}, {"stage_id": 1}]), jobs(spark, [{"config": KRYO}])
    register_rule("many_stages", many_stages)
    try:
        with pytest.raises(ValueError):
            register_rule("many_stages", many_stages)
        assert {f.rule_id for f in run_rules(table, job_table).collect()} >= {"many_stages", "task_failures"}
        chosen = run_rules(table, job_table, rules=["many_stages", "driver_memory"]).collect()
        assert [f.rule_id for f in chosen] == ["many_stages"]
    finally:
        unregister_rule("many_stages")
    with pytest.raises(ValueError):
        run_rules(table, job_table, Thresholds(), ["data_skew"])
    with pytest.raises(ValueError):
        run_rules(table, job_table, rules=["many_stages"])
    assert list(rules.BUILT_IN)[0] == "data_skew" and len(rules.BUILT_IN) == 17


def test_lowered_thresholds(spark):
    t = Thresholds(skew_warning_ratio=2.0, skew_critical_ratio=1.5)
    got, _ = severities(spark, "data_skew", [{}], t=t)
    assert got == ["CRITICAL"]
