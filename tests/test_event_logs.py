import gzip
import json
import os
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import events, metrics, run_history
from fleetgauge.plans.analyze import Fleet, analyze_jobs, fold_event_logs, fold_events, publish_runs, record_runs
from fleetgauge.plans.rules import BUILT_IN, order_findings, run_rules
from fleetgauge.sources import staging
from fleetgauge.sources.event_logs import list_event_logs, scan_event_log
from fleetgauge.sources.run_tables import RunTables, read_documents
from fleetgauge.sources.runs import result_rows, run_rows, scan_runs, sink_results
from fleetgauge.streaming.logs import failures_writer, fetch_logs, poll_batch, start_processed, stream_event_logs

T0 = 1_700_000_000_000


def line(event, **fields):
    return json.dumps({"Event": f"SparkListener{event}", **fields})


def task(stage, run=100, gc=0, launch=T0, finish=None, failed=False, reason="Success", **metrics_):
    return line(
        "TaskEnd",
        **{
            "Stage ID": stage,
            "Task End Reason": {"Reason": reason},
            "Task Info": {"Launch Time": launch, "Finish Time": launch + run if finish is None else finish, "Failed": failed},
            "Task Metrics": {"Executor Run Time": run, "JVM GC Time": gc, **metrics_},
        },
    )


def stage(stage_id, name="s", completion=T0 + 1000, accumulables=()):
    info = {"Stage ID": stage_id, "Stage Name": name, "Submission Time": T0, "Completion Time": completion}
    return line("StageCompleted", **{"Stage Info": {**info, "Accumulables": list(accumulables)}})


def start(app="app", at=T0):
    return line("ApplicationStart", **{"App Name": "job", "App ID": app, "Timestamp": at})


def end(at):
    return line("ApplicationEnd", Timestamp=at)


def environment(**properties):
    return line("EnvironmentUpdate", **{"Spark Properties": {k.replace("_", "."): v for k, v in properties.items()}})


def fold(spark, tmp_path, lines, name="log", staged=False):
    (tmp_path / name).write_text("\n".join(lines))
    return fold_event_logs(spark, str(tmp_path), staged)


def sample_lines():
    def shuffled(read, written, spill=0, spill_memory=0):
        return {
            "Shuffle Read Metrics": {"Remote Bytes Read": read},
            "Shuffle Write Metrics": {"Shuffle Bytes Written": written},
            "Disk Bytes Spilled": spill,
            "Memory Bytes Spilled": spill_memory,
        }

    properties = {
        "spark.executor.memory": "4g", "spark.executor.cores": "4", "spark.executor.instances": "10",
        "spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.enabled": "false", "spark.driver.memory": "2g",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    return [
        start("application_1"),
        line("EnvironmentUpdate", **{"Spark Properties": properties}),
        stage(0, "csv scan", T0 + 10_000),
        task(0, 1900, 50, T0 + 1000, T0 + 3000, **shuffled(0, 104857600)),
        task(0, 2400, 60, T0 + 1000, T0 + 3500, **shuffled(0, 104857600)),
        stage(1, "SortMergeJoin", T0 + 60_000),
        task(1, 11500, 3000, T0 + 10_000, T0 + 22_000, **shuffled(500000000, 100000000, 2000000000, 5000000000)),
        task(1, 12000, 2800, T0 + 10_000, T0 + 22_500, **shuffled(480000000, 95000000, 1800000000, 4500000000)),
        task(1, 335000, 80000, T0 + 10_000, T0 + 350_000, **shuffled(15000000000, 3000000000, 20000000000, 50000000000)),
        end(T0 + 400_000),
    ]


@pytest.mark.parametrize("staged", [False, True])
def test_small_job_end_to_end(spark, tmp_path, staged):
    fleet = fold(spark, tmp_path, sample_lines(), staged=staged)
    job = fleet.jobs.first()
    assert (job.app_id, job.app_name, job.spark_version, job.duration_ms) == ("application_1", "job", "", 400_000)
    assert (job.ex_count, job.ex_task_ms, job.ex_alloc_mem) == (0, 362_800, 0)
    first, second = fleet.stages.orderBy("stage_id").collect()
    assert (first.task_count, first.sum_run_ms, first.gc_ms, first.shuffle_write_bytes) == (2, 4300, 110, 209715200)
    assert (second.task_count, second.sum_run_ms, second.gc_ms) == (3, 358_500, 85_800)
    assert (second.shuffle_read_bytes, second.shuffle_write_bytes) == (15980000000, 3195000000)
    assert (second.spill_disk_bytes, second.spill_memory_bytes) == (23800000000, 59500000000)
    run = second.dist.executor_run_time
    assert (run.min, run.p25, run.median, run.p75, run.max) == (11500, 11750, 12000, 173500, 335000)
    assert second.dist.input_metrics.bytes.max == 0
    found = order_findings(run_rules(fleet.stages, fleet.jobs, by="log_path"), "log_path").collect()
    assert [(f.rule_id, f.severity, f.stage_id) for f in found] == [
        ("spill_to_disk", "CRITICAL", 1),
        ("gc_pressure", "WARNING", 1),
    ]
    assert found[0].message.startswith("22.2 GB spilled")
    rows = analyze_jobs(fleet).collect()
    assert {(r.app_id, r.rule_id) for r in rows} == {("application_1", "spill_to_disk"), ("application_1", "gc_pressure")}


def test_analysis_is_recorded_and_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    fleet = fold(spark, tmp_path / "in", sample_lines())
    (tmp_path / "in" / "clean").write_text("\n".join([start("clean"), end(T0 + 5)]))
    fleet = fold_event_logs(spark, str(tmp_path / "in")).staged()
    now = datetime(2026, 3, 1, 12)
    for i in range(2):
        sink_results(record_runs(fleet, now + timedelta(hours=i)), str(tmp_path / "runs"))
    stored = scan_runs(spark, str(tmp_path / "runs"))
    runs, results = run_rows(stored), result_rows(stored, list(BUILT_IN))
    assert runs.count() == 4 and results.count() == 4
    frequency = run_history.rule_frequency(runs, results, "2026-03-02 00:00:00", 7).collect()
    assert {(r.rule_id, r["count"]) for r in frequency} == {("spill_to_disk", 2), ("gc_pressure", 2)}
    assert run_history.daily_volume(runs, "2026-03-02 00:00:00", 7).first()["count"] == 4
    assert {str(r.created_at) for r in runs.collect()} == {"2026-03-01 12:00:00", "2026-03-01 13:00:00"}


def test_analysis_is_published(spark, tmp_path):
    (tmp_path / "in").mkdir()
    fleet = fold(spark, tmp_path / "in", sample_lines())
    root, now = str(tmp_path / "runs"), datetime(2026, 3, 1, 12)
    assert publish_runs(fleet, now, root, mode="it's", name="noon") and publish_runs(fleet, now, root, name="noon") is None
    tables = RunTables(spark, root)
    assert tables.runs.first().mode == "it's"
    one = json.loads(read_documents(tables, tables.runs).first().result_json)
    assert [f["rule_id"] for f in one["rule_results"]] == ["spill_to_disk", "gc_pressure"] and one["job"]["app_id"] == "application_1"
    stages = {r.stage_id: r for r in fleet.stages.collect()}
    assert {s["stage_id"]: s["spill_disk_bytes"] for s in one["job"]["stages"]} == {i: r.spill_disk_bytes for i, r in stages.items()}


def test_noise_is_dropped(spark, tmp_path):
    lines = ["", "   ", "not json", '{"Event":"SparkListenerTaskEnd","Stage ID":0,"Task', start(), line("BlockUpdated"), "{}",
             '{"no event": 1}', stage(0), task(0), '  ' + task(0) + '  ']
    fleet = fold(spark, tmp_path, lines)
    assert fleet.stages.first().task_count == 2


def test_tasks_need_info_and_metrics(spark, tmp_path):
    base = {"Stage ID": 0, "Task Info": {"Launch Time": 1, "Finish Time": 5, "Failed": True}}
    lines = [
        start(), stage(0),
        line("TaskEnd", **base),
        line("TaskEnd", **base, **{"Task Metrics": {}}),
        line("TaskEnd", **base, **{"Task Metrics": None}),
        line("TaskEnd", **{"Stage ID": 0, "Task Info": {}, "Task Metrics": {"Executor Run Time": 1}}),
        line("TaskEnd", **base, **{"Task Metrics": {"Executor CPU Time": 7}}),
        task(0, failed=True, reason="ExceptionFailure"),
        task(0, reason="TaskKilled"),
    ]
    row = fold(spark, tmp_path, lines).stages.first()
    assert (row.task_count, row.failed_tasks, row.killed_tasks) == (3, 2, 1)


def test_absent_and_null_metrics_count_as_zero(spark, tmp_path):
    lines = [start(), stage(0), task(0, 10, None, **{"Shuffle Read Metrics": None, "Disk Bytes Spilled": None}),
             task(0, 20, 4, **{"Shuffle Read Metrics": {"Remote Bytes Read": 5, "Local Bytes Read": 7, "Total Records Read": 3}})]
    row = fold(spark, tmp_path, lines).stages.first()
    assert (row.sum_run_ms, row.gc_ms, row.shuffle_read_bytes, row.shuffle_read_records) == (30, 4, 12, 3)


@pytest.mark.parametrize(
    "tail, duration",
    [
        ([end(T0 + 9)], 9),
        ([], 0),
        ([stage(0, completion=T0 + 50), stage(1, completion=T0 + 70)], 70),
        ([stage(0, completion=T0 + 50), end(T0)], 50),
        ([stage(0, completion=T0 - 50)], -50),
        ([line("StageCompleted", **{"Stage Info": {"Stage ID": 3}})], -T0),
        ([end(T0 + 5), end(T0 + 9)], 9),
    ],
)
def test_duration(spark, tmp_path, tail, duration):
    assert fold(spark, tmp_path, [start(), *tail]).jobs.first().duration_ms == duration


def test_last_record_wins(spark, tmp_path):
    lines = [
        environment(spark_a="1", spark_b="1"), start("first"), start("second", T0 + 1),
        stage(0, "old", accumulables=[{"Name": events.INPUT_BYTES, "Value": 1}]),
        environment(spark_b="2", spark_c="3"),
        stage(0, "new", accumulables=[
            {"Name": "other", "Value": {"nested": []}},
            {"Name": events.INPUT_BYTES, "Value": "42"},
            {"Name": events.INPUT_BYTES, "Value": 99},
            {"Name": events.OUTPUT_BYTES, "Value": 7},
        ]),
        task(0), task(0), task(5),
        line("ExecutorAdded"), line("ExecutorRemoved"), line("ExecutorAdded"),
    ]
    fleet = fold(spark, tmp_path, lines)
    job, rows = fleet.jobs.first(), fleet.stages.collect()
    assert job.app_id == "second" and job.config == {"spark.a": "1", "spark.b": "2", "spark.c": "3"}
    assert job.ex_count == 2 and job.ex_task_ms == 300  # the orphan task counts
    assert [(r.stage_id, r.stage_name, r.input_bytes, r.output_bytes, r.task_count) for r in rows] == [(0, "new", 42, 7, 2)]


def test_order_survives_splits(spark, tmp_path):
    lines = [start()] + [environment(spark_k=str(i), **{f"spark_k{i}": "x" * 50}) for i in range(2000)]
    (tmp_path / "log").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16 * 1024)
    try:
        lines = scan_event_log(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        config = events.config_fold(events.parse_events(lines)).first().config
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert config["spark.k"] == "1999" and len(config) == 2001


def lz4(data):
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "lz4") as stream:
        stream.write(data)
    return sink.getvalue().to_pybytes()


def test_every_codec_gives_the_same_lines(spark, tmp_path):
    text = "\n".join([start(), stage(0), *[task(0, i) for i in range(25_000)]])
    data = text.encode()
    contents = {
        "plain": data,
        "plain.json": data,
        "log.gz": gzip.compress(data),
        "log.gz.json": gzip.compress(data),
        "log.GZ": gzip.compress(data),
        "log.lz4": lz4(data),
        "log.snappy": pa.compress(data, codec="snappy", asbytes=True),
        "log.zstd": pa.compress(data, codec="zstd", asbytes=True),
        "log.zst": pa.compress(data, codec="zstd", asbytes=True),
        "log.ZST": pa.compress(data, codec="zstd", asbytes=True),
    }
    (tmp_path / "sub").mkdir()
    for i, (name, content) in enumerate(contents.items()):
        (tmp_path / ("sub" if i % 2 else "") / name).write_bytes(content)
    listed = {r["name"]: r["size"] for r in list_event_logs(spark, str(tmp_path)).collect()}
    assert listed == {name: len(content) for name, content in contents.items()}
    fleet = fold_event_logs(spark, str(tmp_path), staged=False)
    rows = fleet.stages.select("log_path", "task_count", "sum_run_ms", "dist.executor_run_time.median").collect()
    assert {r.log_path.rsplit("/", 1)[1] for r in rows} == set(contents)
    assert {tuple(r)[1:] for r in rows} == {(25_000, sum(range(25_000)), 12499.0)}


def test_result_does_not_depend_on_partitioning(spark, tmp_path):
    (tmp_path / "a").write_text("\n".join(sample_lines()))
    (tmp_path / "b").write_text("\n".join([start("b"), stage(3), *[task(3, i) for i in range(100)]]))
    lines = scan_event_log(spark, str(tmp_path))
    one, many = fold_events(lines.coalesce(1), staged=False), fold_events(lines.repartition(7), staged=False)
    assert sorted(map(str, one.stages.collect())) == sorted(map(str, many.stages.collect()))
    assert sorted(map(str, one.jobs.collect())) == sorted(map(str, many.jobs.collect()))


def test_log_of_tasks_only(spark, tmp_path):
    fleet = fold(spark, tmp_path, [task(0, 5), task(1, 6)])
    job = fleet.jobs.first()
    assert (job.app_id, job.duration_ms, job.ex_task_ms, job.config) == ("", 0, 11, {}) and fleet.stages.count() == 0


def test_two_logs_of_one_application_stay_apart(spark, tmp_path):
    for name, run in (("attempt1", 5), ("attempt2", 7)):
        (tmp_path / name).write_text("\n".join([start("same"), stage(0), task(0, run)]))
    fleet = fold_event_logs(spark, str(tmp_path), staged=False)
    assert isinstance(fleet, Fleet) and fleet.jobs.count() == 2
    assert sorted(r.sum_run_ms for r in fleet.stages.collect()) == [5, 7]
    assert metrics.job_overview(fleet.stages, fleet.jobs, "log_path").count() == 2


def test_stream_picks_up_logs_of_any_age(spark, tmp_path):
    logs, seen = tmp_path / "logs", []
    logs.mkdir()

    def publish(fleet, batch_id):
        seen.extend(r.app_id for r in fleet.jobs.collect())

    for names in (["new"], ["newer", "old"]):
        for name in names:
            (logs / name).write_text("\n".join([start(name), stage(0), task(0, 5)]))
        if "old" in names:
            os.utime(logs / "old", (1_000_000_000, 1_000_000_000))
        stream_event_logs(spark, str(logs), str(tmp_path / "checkpoint"), publish).awaitTermination()
    assert sorted(seen) == ["new", "newer", "old"]


def test_list_and_scans_name_a_log_alike(spark, tmp_path):
    for name, content in {"a b.json": b"x\n", "c d.lz4": lz4(b"\xff y\n")}.items():
        (tmp_path / name).write_bytes(content)
    listed = list_event_logs(spark, str(tmp_path))
    scanned = scan_event_log(spark, str(tmp_path)).select(F.col("log_path").alias("path"), "value")
    rows = listed.join(scanned, "path").select("name", "value").collect()
    assert sorted(map(tuple, rows)) == [("a b.json", "x"), ("c d.lz4", "\ufffd y")]


def test_damaged_logs_do_not_hold_up_the_others(spark, tmp_path):
    logs, seen = tmp_path / "logs", []
    logs.mkdir()
    damaged = {"cut.gz": gzip.compress(os.urandom(50_000))[:-20_000], "bad.snappy": b"\xff\xff\xff\xff\x0fxx", "bad.zst": b"no zstd"}
    for name, content in damaged.items():
        (logs / name).write_bytes(content)
    good = "\n".join([start("good"), stage(0), task(0, 5)])
    (logs / "good.gz").write_bytes(gzip.compress(good.encode()))
    (logs / "plain").write_text(good.replace("good", "plain"))

    def publish(fleet, batch_id):
        seen.extend(r.app_id for r in fleet.jobs.collect())

    failures = str(tmp_path / "failures")
    stream_event_logs(
        spark, str(logs), str(tmp_path / "checkpoint"), publish, on_failed=failures_writer(failures)
    ).awaitTermination()
    assert sorted(seen) == ["good", "plain"]
    rows = spark.read.parquet(failures).collect()
    assert {r.log_path.rsplit("/", 1)[1] for r in rows} == set(damaged) and all(r.error for r in rows)


def test_damaged_logs_are_tried_again(spark, tmp_path):
    logs, state, seen = tmp_path / "logs", str(tmp_path / "state"), []
    logs.mkdir()
    (logs / "plain").write_text("\n".join([start("plain"), stage(0), task(0, 5)]))
    (logs / "cut.gz").write_bytes(gzip.compress(os.urandom(5_000))[:-2_000])
    start_processed(spark, state)
    fetch = fetch_logs(spark, str(logs), lambda fleet: seen.extend(r.app_id for r in fleet.jobs.collect()))
    for batch in range(2):
        poll_batch(spark, list_event_logs(spark, str(logs)).selectExpr("path AS key"), state, batch, fetch)
        (logs / "cut.gz").write_bytes(gzip.compress("\n".join([start("mended"), stage(0), task(0, 5)]).encode()))
    assert seen == ["plain", "mended"]


def test_staged_tables_are_deleted_after_a_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "staging_root", lambda spark: str(tmp_path / "shared"))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a").write_text("\n".join([start("a"), stage(0), task(0, 5)]))
    seen = []
    stream_event_logs(
        spark, str(tmp_path / "logs"), str(tmp_path / "checkpoint"), lambda fleet, _: seen.append(fleet.jobs.count())
    ).awaitTermination()
    assert seen == [1] and list((tmp_path / "shared" / "fleetgauge").iterdir()) == []
