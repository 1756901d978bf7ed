import json

from fleetgauge.operators.history_server import base_path, hs_dedup_stages, hs_quantiles
from fleetgauge.plans.analyze import analyze_jobs, fold_history
from fleetgauge.sources.history_payloads import scan_history_json


def save(root, kind, app, payload):
    folder = root / kind / f"app_id={app}"
    folder.mkdir(parents=True)
    (folder / "payload.json").write_text(json.dumps(payload, indent=1))


def five(*values):
    return list(values)


def saved(tmp_path):
    save(tmp_path, "applications", "a1", {"id": "a1", "name": "etl", "attempts": [
        {"attemptId": "1", "duration": 5, "appSparkVersion": "2.4.0"},
        {"attemptId": "2", "duration": 600000, "appSparkVersion": "3.4.1"},
    ]})
    save(tmp_path, "applications", "a2", {"id": "a2", "name": "empty", "attempts": []})
    save(tmp_path, "environment", "a1", {"sparkProperties": [["k", "1"], ["only"], ["k", "2"], ["spark.executor.cores", "2", "x"]]})
    save(tmp_path, "stages", "a1", [
        {"stageId": 2, "attemptId": 0, "name": "old", "numTasks": 1, "executorRunTime": 9},
        {"stageId": 1, "name": "first", "numTasks": 12, "executorRunTime": 120000, "jvmGcTime": 60000, "inputBytes": None},
        {"stageId": 2, "attemptId": 1, "numTasks": 10, "executorRunTime": 1000, "shuffleReadBytes": 7, "numKilledTasks": 3},
        {"stageId": 1, "attemptId": 0, "name": "tie", "numTasks": 99},
        {"stageId": 2, "attemptId": 7, "name": "still running", "numTasks": 99, "status": "ACTIVE"},
    ])
    save(tmp_path, "taskSummary", "a1", [
        {"stageId": 2, "attemptId": 0, "executorRunTime": five(9, 9, 9, 9, 9)},
        {"stageId": 2, "attemptId": 1, "executorRunTime": [1, 2, 3], "executorCpuTime": five(1e6, 2e6, 3e6, 4e6, 5e6),
         "jvmGcTime": ["x", None, 4], "duration": [], "inputMetrics": None,
         "shuffleWriteMetrics": {"writeTime": five(0, 0, 1500000, 0, 0), "writeBytes": five(1, 2, 3, 4, 5)}},
    ])
    save(tmp_path, "executors", "a1", [
        {"id": "driver", "maxMemory": 1000, "totalCores": 50},
        {"id": "1", "maxMemory": 100, "totalDuration": 10, "totalCores": 4, "peakMemoryMetrics": {"JVMHeapMemory": 30}},
        {"id": "2", "maxMemory": 100, "totalDuration": None, "failedTasks": 2, "peakMemoryMetrics": None},
    ])
    save(tmp_path, "executors", "a2", [{"id": "driver"}])
    return str(tmp_path)


def test_payloads_become_stages_and_jobs(spark, tmp_path):
    payloads = scan_history_json(spark, saved(tmp_path))
    fleet = fold_history(payloads)
    two, one = fleet.stages.orderBy("stage_pos").collect()
    assert (two.stage_id, two.stage_name, two.task_count, two.killed_tasks, two.shuffle_read_bytes) == (2, "Stage 2", 10, 3, 7)
    assert (one.stage_id, one.stage_name, one.task_count, one.input_bytes) == (1, "first", 12, 0)
    assert tuple(two.dist.executor_run_time) == (1, 2, 3, 3, 3)
    assert tuple(two.dist.executor_cpu_time) == (1, 2, 3, 4, 5)
    assert tuple(two.dist.jvm_gc_time) == (0, 0, 4, 4, 4) and tuple(two.dist.duration) == (0,) * 5
    assert two.dist.shuffle_write_metrics.write_time.median == 1.5 and two.dist.input_metrics.bytes.max == 0
    assert tuple(one.dist.executor_run_time) == (0,) * 5
    a1, a2 = fleet.jobs.orderBy("app_id").collect()
    assert (a1.spark_version, a1.duration_ms, a1.config) == ("3.4.1", 600000, {"k": "2", "spark.executor.cores": "2"})
    assert (a1.ex_count, a1.ex_peak_mem, a1.ex_alloc_mem, a1.ex_task_ms, a1.ex_failed, a1.ex_cores) == (2, 30, 200, 10, 2, 4)
    assert (a2.spark_version, a2.duration_ms, a2.config, a2.ex_count) == ("", 0, {}, 0)
    found = {(r.app_id, r.rule_id, r.severity) for r in analyze_jobs(fleet).collect()}
    assert ("a1", "gc_pressure", "CRITICAL") in found and ("a1", "executor_idle", "CRITICAL") in found
    assert ("a1", "memory_underutilization", "WARNING") not in found  # a hot stage rules it out


def test_paths_follow_the_latest_attempt(spark, tmp_path):
    applications = scan_history_json(spark, saved(tmp_path)).applications
    rows = applications.selectExpr("id", f"{base_path()} AS p").collect()
    assert {r.id: r.p for r in rows} == {"a1": "/applications/a1/2", "a2": "/applications/a2"}


def test_dedup_keeps_first_seen_order_and_first_of_ties(spark):
    rows = [("a", 3, 0, "x", 0), ("a", 1, 1, "y", 1), ("a", 3, 2, "z", 2), ("a", 3, 2, "late tie", 3), ("a", 1, 0, "w", 4)]
    stages = spark.createDataFrame(rows, "app_id string, stageId bigint, attemptId bigint, name string, pos bigint")
    kept = hs_dedup_stages(stages).orderBy("pos").collect()
    assert [(r.stageId, r["name"]) for r in kept] == [(3, "z"), (1, "y")]


def test_quantile_slots(spark):
    df = spark.createDataFrame([(["1", "x", "3"],), ([],), (None,)], "s array<string>")
    rows = [tuple(r.q) for r in df.selectExpr(f"{hs_quantiles('s')} AS q").collect()]
    assert rows == [(1, 0, 3, 3, 3), (0,) * 5, (0,) * 5]


def test_stage_order_survives_splits(spark, tmp_path):
    folder = tmp_path / "stages" / "app_id=a"
    folder.mkdir(parents=True)
    ids = [(i * 7919) % 5000 for i in range(5000)]
    (folder / "part.json").write_text("\n".join(json.dumps({"stageId": i, "name": "n" * 40}) for i in ids))
    for kind in ("applications", "environment", "taskSummary", "executors"):
        save(tmp_path, kind, "a", {"id": "a", "stageId": 0})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16 * 1024)
    try:
        stages = scan_history_json(spark, str(tmp_path), multi_line=False).stages
        assert stages.rdd.getNumPartitions() > 3
        rows = stages.orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.stageId for r in rows] == ids
