"""Payload queries write what they read, and small files share tasks."""

from fleetgauge.session import configure
from workload import adapters, catalog
from __spark_entry__ import SMOKE_DIR


def test_payloads_of_applications_need_no_task(spark, monkeypatch):
    def none_wanted(*_):
        raise AssertionError("tasks were asked for")

    monkeypatch.setattr(adapters, "_staged", {})
    monkeypatch.setattr(adapters, "_plans", {})
    monkeypatch.setattr(adapters, "lineitem_tasks", none_wanted)
    n = spark.read.parquet(f"{SMOKE_DIR}/supplier.parquet").count()
    for name in ("hs_environment", "hs_executors", "hs_job"):
        assert catalog.QUERIES[name](spark, SMOKE_DIR).select("app_id").distinct().count() == n


def test_all_payloads_are_those_of_both_folders(spark):
    whole = adapters.payloads(spark, SMOKE_DIR)
    counts = [whole.applications.count(), whole.environments.count(), whole.executors.count()]
    assert counts[0] == counts[1] == counts[2] / 4 > 0
    assert whole.stages.count() > 0 and whole.summaries.count() > 0


def test_small_files_share_tasks(spark, tmp_path):
    own = configure(spark.newSession())
    for i in range(640):
        (tmp_path / f"app_id=a{i}").mkdir()
        (tmp_path / f"app_id=a{i}" / "part-0.txt").write_text("one\n")
    read = own.read.text(str(tmp_path))
    assert read.count() == 640
    assert read.rdd.getNumPartitions() <= 20
