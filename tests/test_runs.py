import json
from datetime import datetime, timedelta

import pyarrow as pa

from fleetgauge.operators import dedup, run_history, run_state
from fleetgauge.plans.analyze import fold_event_logs
from fleetgauge.plans.rules import BUILT_IN
from fleetgauge.sources.runs import decode_runs, result_documents, result_rows, run_rows, scan_runs, sink_properties, sink_results
from fleetgauge.streaming import logs as log_stream
from fleetgauge.streaming import status as status_stream
from pyspark.sql import functions as F

NOW = datetime(2026, 3, 31)
RUN = (
    "task_id string, app_id string, mode string, data_source string, status string, created_at timestamp, "
    "started_at timestamp, completed_at timestamp, error string, has_result boolean, has_report boolean"
)
FINDING = (
    "task_id string, rule_id string, severity string, sev_order int, rule_ord int, stage_id bigint, stage_pos bigint, "
    "title string, message string, current_value string, recommended_value string, estimated_impact string"
)


def at(days_ago, seconds=0):
    return NOW - timedelta(days=days_ago) + timedelta(seconds=seconds)


def run(task, app="a", status="completed", age=1.0, took=10, mode="ai", source="file", report=False):
    created = at(age)
    started = created if status != "pending" else None
    done = created + timedelta(seconds=took) if status in ("completed", "failed") else None
    return (task, app, mode, source, status, created, started, done, None, status == "completed", report)


def runs_table(spark, *rows):
    return spark.createDataFrame(rows, RUN)


def results_table(spark, *rows):
    order = {"CRITICAL": 0, "WARNING": 1, "INFO": 2}
    ids = list(BUILT_IN)
    return spark.createDataFrame(
        [(t, r, s, order[s], ids.index(r), stage, stage, title, f"about {title}", "", "", "") for t, r, s, stage, title in rows],
        FINDING,
    )


def fleet_of_runs(spark):
    runs = runs_table(
        spark,
        run("1", "x", age=3, took=10, report=True), run("2", "x", age=2, took=21, mode="static"), run("3", "y", age=1, took=5),
        run("4", "y", "failed", age=1), run("5", "z", "running", age=0.5), run("6", "z", "pending", age=40),
        run("7", "x", age=40), run("8", "w", age=30.00001, took=5),
    )
    results = results_table(
        spark,
        ("1", "data_skew", "CRITICAL", 1, "oldest"), ("1", "data_skew", "WARNING", 2, "oldest last"),
        ("2", "data_skew", "INFO", 1, "newer"), ("2", "gc_pressure", "WARNING", 1, "gc"), ("7", "gc_pressure", "INFO", 1, "outside"),
        ("8", "small_files", "INFO", 1, "finished inside"),
    )
    return runs, results


def test_statistics(spark):
    runs, results = fleet_of_runs(spark)
    summary = run_history.stats_summary(runs, results, NOW, 30).first()
    # run 8 was created before the window and finished inside it
    assert tuple(summary) == (5, 3, 1, 10.25, 33.3, 1.2)
    frequency = {r.rule_id: tuple(r)[1:] for r in run_history.rule_frequency(runs, results, NOW, 30).collect()}
    assert frequency["data_skew"] == ("oldest last", 3, "WARNING")
    assert frequency["gc_pressure"] == ("gc", 1, "WARNING")
    top = run_history.top_issues(runs, results, NOW, 30, 1).collect()
    assert [(r.rule_id, r["count"], r.example_app_id, r.message) for r in top] == [("data_skew", 3, "x", "about oldest last")]
    trend = {r.day: tuple(r)[1:] for r in run_history.severity_trend(runs, results, NOW, 30).collect()}
    assert trend == {"2026-03-28": (1, 1, 0), "2026-03-29": (0, 1, 1), "2026-03-30": (0, 0, 0), "2026-03-01": (0, 0, 1)}
    rates = {r.day: tuple(r)[1:] for r in run_history.failure_rate_trend(runs, NOW, 30).collect()}
    assert rates["2026-03-30"] == (3, 1, 33.3)
    by_mode = {r.mode: tuple(r)[1:] for r in run_history.duration_by_mode(runs, NOW, 30).collect()}
    assert by_mode == {"ai": (6.67, 3), "static": (21.0, 1)}


def test_statistics_without_completed_runs(spark):
    runs = runs_table(spark, run("1", status="failed"), run("2", "w", age=30.00001, took=5))
    summary = run_history.stats_summary(runs, results_table(spark, ("2", "data_skew", "INFO", 1, "t")), NOW, 30).first()
    assert tuple(summary) == (1, 0, 1, None, None, None)


def test_paging_and_lookups(spark):
    runs, _ = fleet_of_runs(spark)
    page = run_history.list_runs(runs, limit=2, offset=1, app_id="x").collect()
    assert [(r.task_id, r.total) for r in page] == [("1", 3), ("7", 3)]
    assert run_history.list_runs(runs, limit=None, status="completed", data_source="hdfs").count() == 0
    assert {r.app_id: r.task_id for r in run_history.latest_run_per_app(runs).collect()} == {"w": "8", "x": "2", "y": "4", "z": "5"}
    wanted = spark.createDataFrame([("x",), ("nope",)], "app_id string")
    assert [tuple(r) for r in run_history.count_by_app_ids(runs, wanted).collect()] == [("x", 3)]
    assert run_history.get_run(runs, "3").first().app_id == "y"
    grouped = run_history.group_runs_by_app(run_history.list_runs(runs)).orderBy("app_id").collect()
    assert [(g.app_id, g.task_ids) for g in grouped][1] == ("x", ["2", "1", "7"])


def test_documents_survive_a_round_trip_in_parts(spark, tmp_path):
    runs, _ = fleet_of_runs(spark)
    many = results_table(spark, *[("1", "data_skew", "WARNING", i, f"t{i}") for i in range(50)], ("2", "gc_pressure", "INFO", 1, "gc"))
    documents = result_documents(runs, many, per_part=8)
    sink_results(documents, str(tmp_path / "runs"))
    decoded = scan_runs(spark, str(tmp_path / "runs"))
    assert decoded.filter("task_id = '1'").count() > 1
    assert decoded.selectExpr("max(size(rule_results))").first()[0] < 25
    only_documents = decode_runs(decoded.drop("rule_results", "has_report"))
    for stored in (decoded, only_documents):
        rows = result_rows(stored, list(BUILT_IN))
        assert sorted(r.title for r in rows.collect()) == sorted(r.title for r in many.collect())
        back = {r.task_id: r.has_result for r in run_rows(stored).collect()}
        assert back == {str(i): str(i) in "12378" for i in range(1, 9)}
    one = json.loads(documents.filter("task_id = '2'").first().result_json)
    assert one["app_id"] == "x" and [r["rule_id"] for r in one["rule_results"]] == ["gc_pressure"]


def test_documents_of_any_version(spark):
    finding = '{"rule_id": "r", "severity": "INFO", "stage_id": 3, "title": "t", "later": {"x": [1]}}'
    documents = {
        "whole": f'{{"app_id": "a", "rule_results": [{finding}], "ai_report": {{"summary": "s"}}, "version": 9}}',
        "other types": '{"rule_results": [{"rule_id": 5, "stage_id": "x"}, null, 7], "ai_report": "none"}',
        "no findings": '{"rule_results": [], "ai_report": null}',
        "fields missing": "{}",
        "not an object": "[1]",
        "cut": f'{{"rule_results": [{finding}',
        "empty": "",
        "null": None,
    }
    stored = spark.createDataFrame(list(documents.items()), "task_id string, result_json string")
    got = {r.task_id: r for r in decode_runs(stored).collect()}
    whole = got["whole"].rule_results[0]
    assert (whole.rule_id, whole.severity, whole.stage_id, whole.title, whole.message) == ("r", "INFO", 3, "t", None)
    assert [(f.rule_id, f.stage_id) for f in got["other types"].rule_results] == [("5", None), (None, None), (None, None)]
    assert got["no findings"].rule_results == []
    assert {i for i, r in got.items() if r.rule_results is None} == {"fields missing", "not an object", "cut", "empty", "null"}
    assert {i for i, r in got.items() if r.has_report} == {"whole"} and got["whole"].part == 0


def test_properties_file(spark, tmp_path):
    entries = spark.createDataFrame([("a", "k", "1"), ("a", "l", "2"), ("b", "k", "3")], "app_id string, parameter string, recommended_value string")
    sink_properties(entries, str(tmp_path / "p"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "p" / "app_id=a")).collect()) == ["k = 1", "l = 2"]


def test_admission(spark):
    runs = runs_table(spark, run("1", "done"), run("2", "busy", "running"), run("3", "busy", age=5))
    asked = [(1, "new", False), (2, "new", True), (3, "new", False), (4, "done", True), (5, "busy", False), (6, "busy", True)]
    requests = spark.createDataFrame(asked, "request_id bigint, app_id string, rerun boolean")
    rows = run_state.admit_requests(requests, runs).orderBy("request_id").collect()
    assert [r.decision for r in rows] == ["create", "conflict", "skip", "create", "skip", "conflict"]
    assert [r.active_task_id for r in rows] == [None, None, None, None, "2", "2"]


def test_histogram_quantile(spark):
    rows = [run(str(i), took=t) for i, t in enumerate((1, 2, 3, 4, 8, 9, 200, 250, 400, 500))]
    histogram = run_state.duration_histogram(runs_table(spark, *rows))
    counts = {r.le: r.cumulative for r in histogram.collect()}
    assert counts == {1.0: 1, 5.0: 4, 10.0: 6, 30.0: 6, 60.0: 6, 120.0: 6, 300.0: 8, float("inf"): 10}
    assert run_state.histogram_quantile(histogram, 0.5).first().estimate == 7.5
    assert run_state.histogram_quantile(histogram, 0.95).first().estimate == 300.0


def test_processed_table(spark):
    schema = "key string, processed_at timestamp"
    processed = spark.createDataFrame([("a", at(3)), ("b", at(2))], schema)
    asked = spark.createDataFrame([("b",), ("c",), ("d",)], "key string")
    new, table = dedup.filter_new_and_mark(asked, processed, F.lit(NOW), cap=3)
    assert sorted(r.key for r in new.collect()) == ["c", "d"]
    assert {r.key: r.processed_at for r in table.collect()} == {"b": at(2), "c": NOW, "d": NOW}
    again = dedup.mark_processed(processed, processed, F.lit(NOW))
    assert {r.key: r.processed_at for r in again.collect()} == {"a": at(3), "b": at(2)}
    left = dedup.retry_failed(processed, asked)
    assert [r.key for r in left.collect()] == ["a"]


def test_poll_marks_only_what_was_fetched(spark, tmp_path):
    state = str(tmp_path / "state")
    log_stream.start_processed(spark, state)
    candidates = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    fetched = []

    def fetch(new):
        keys = sorted(r.key for r in new.collect())
        fetched.append(keys)
        return spark.createDataFrame([(k,) for k in keys if k == "b" and len(fetched) == 1], "key string")

    for batch in (0, 1, 1, 2):  # batch 1 is repeated
        log_stream.poll_batch(spark, candidates, state, batch, fetch)
    assert fetched == [["a", "b", "c"], ["b"], ["b"], []]
    assert log_stream.read_processed(spark, state, 99).count() == 3


STATUS = "task_id string, app_id string, mode string, status string, ts timestamp, error string"


def status_files(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).parquet(path)


def status_rows():
    return [
        [("1", "a", "ai", "pending", at(1), None), ("2", "b", "ai", "pending", at(1), None)],
        [("1", "a", "ai", "failed", at(1, 9), "boom"), ("2", "b", "ai", "running", at(1, 2), None)],
        [("1", "a", "ai", "running", at(1, 3), None), ("2", "b", "ai", "completed", at(1, 2), None)],  # late and equal stamps
    ]


def collect_stream(start, tmp_path):
    batches = {}

    def write(df, batch_id):
        batches[batch_id] = df.collect()

    start(write, str(tmp_path / "checkpoint")).awaitTermination()
    return [batches[i] for i in sorted(batches)]


def test_status_stream_settles_late_events(spark, tmp_path):
    stream = status_files(spark, str(tmp_path / "in"), status_rows())
    batches = collect_stream(lambda w, c: status_stream.stream_run_state(stream, w, c), tmp_path)
    latest = {r.task_id: r for rows in batches for r in rows}
    assert (latest["1"].status, latest["1"].started_at, latest["1"].completed_at, latest["1"].error) == ("failed", at(1, 3), at(1, 9), "boom")
    assert (latest["2"].status, latest["2"].created_at, latest["2"].error) == ("completed", at(1), None)
    table = spark.read.schema(STATUS).parquet(str(tmp_path / "in"))
    assert {r.task_id: r for r in run_state.run_state(table).collect()} == latest


def test_windowed_rates_in_stream_equal_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    for minute in range(30):
        rows = [(str(i), "a", "ai", "pending" if i % 3 else "failed", at(1, 60 * minute + i), None) for i in range(minute)]
        rows.append(("x", "a", "ai", "pending", at(1, 60 * minute), None))
        spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(STATUS).parquet(path)
    batches = collect_stream(
        lambda w, c: status_stream.stream_window_rate(stream, ["status"], w, c, watermark="10 minutes"), tmp_path
    )
    streamed = {(r.window_start, r.status): (r.events, r.rate) for rows in batches for r in rows}
    batch = run_state.window_rate(spark.read.schema(STATUS).parquet(path), ["status"])
    whole = {(r.window_start, r.status): (r.events, r.rate) for r in batch.collect()}
    # windows still open under the watermark are not emitted
    closed = {k: v for k, v in whole.items() if k[0] + timedelta(minutes=5) <= at(1, 60 * 29 + 28) - timedelta(minutes=10)}
    assert streamed == closed and len(closed) > 20


def test_new_logs_are_folded_once(spark, tmp_path):
    logs, checkpoint, seen = tmp_path / "logs", str(tmp_path / "c"), {}
    logs.mkdir()

    def put(name):
        lines = [
            {"Event": "SparkListenerApplicationStart", "App ID": name, "App Name": name, "Timestamp": 1},
            {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 0, "Completion Time": 9}},
            {"Event": "SparkListenerTaskEnd", "Stage ID": 0, "Task Info": {"Launch Time": 1, "Finish Time": 2},
             "Task Metrics": {"Executor Run Time": 5}},
        ]
        data = "\n".join(map(json.dumps, lines)).encode()
        if name == "c":  # one log in a format the text reader cannot decode
            (logs / "c.snappy").write_bytes(pa.compress(data, codec="snappy", asbytes=True))
        else:
            (logs / name).write_bytes(data)

    def publish(fleet, batch_id):
        for r in fleet.jobs.collect():
            seen.setdefault(r.app_id, []).append((batch_id, r.duration_ms, r.ex_task_ms))

    def poll():
        log_stream.stream_event_logs(spark, str(logs), checkpoint, publish, max_files=2).awaitTermination()

    for name in ("a", "b", "c"):
        put(name)
    poll()
    put("d")
    poll()
    assert sorted(seen) == ["a", "b", "c", "d"] and all(len(v) == 1 for v in seen.values())
    assert {v[0][1:] for v in seen.values()} == {(8, 5)}
    assert fold_event_logs(spark, str(logs), staged=False).jobs.count() == 4
