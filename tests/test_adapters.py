import gzip

import pytest

from fleetgauge.session import LISTING_DEFAULT, LISTING_TASKS, LISTING_TASKS_PER_CORE, configure
from workload import adapters


def test_listing_takes_tasks_by_cores_not_by_folders(spark):
    own = spark.newSession()
    own.conf.set(LISTING_TASKS, LISTING_DEFAULT)
    configure(own)
    assert int(own.conf.get(LISTING_TASKS)) == LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    own.conf.set(LISTING_TASKS, "7")
    assert configure(own).conf.get(LISTING_TASKS) == "7"


def log_rows(spark, lines=12_000):
    ids = "CASE id % 3 WHEN 0 THEN 'app_1_0' WHEN 1 THEN 'app_2_0' END AS log_id"
    value = "if(id = 3, NULL, concat('{\"n\": ', id, '}')) AS value"
    return spark.range(3 * lines).selectExpr(ids, "int(id % 2) AS phase", "id AS ord", value)


@pytest.mark.parametrize("through_arrow", [True, False])
def test_a_log_is_one_file_of_ordered_lines(spark, tmp_path, monkeypatch, through_arrow):
    monkeypatch.setattr(adapters, "files_opened", lambda folder: through_arrow)
    adapters._write_logs(log_rows(spark), f"file://{tmp_path}/logs")
    assert {f.name for f in (tmp_path / "logs").iterdir()} == {"plain", "zipped"}
    files = list(tmp_path.glob("logs/*/log_id=*/part-*"))
    assert {f.parent.name for f in files} == {"log_id=app_1_0", "log_id=app_2_0", "log_id=__HIVE_DEFAULT_PARTITION__"}
    assert len(files) == 3
    for file in files:
        zipped = file.parent.parent.name == "zipped"
        assert zipped == (file.suffix == ".gz")
        lines = (gzip.decompress(file.read_bytes()) if zipped else file.read_bytes()).decode().splitlines()
        rest = {"log_id=app_1_0": 0, "log_id=app_2_0": 1}.get(file.parent.name, 2)
        ids = sorted(range(rest, 36_000, 3), key=lambda i: (i % 2, i))
        assert lines == ["" if i == 3 else f'{{"n": {i}}}' for i in ids]


def test_logs_are_written_without_moves_on_the_driver(spark, tmp_path):
    adapters._write_logs(log_rows(spark, 10), f"file://{tmp_path}/logs")
    # Spark's writer commits: it leaves a mark and a checksum beside each file
    assert not list(tmp_path.glob("logs/**/_SUCCESS")) and not list(tmp_path.glob("logs/**/.*.crc"))


def test_no_logs_are_empty_folders(spark, tmp_path):
    adapters._write_logs(log_rows(spark, 0), f"file://{tmp_path}/logs")
    assert spark.read.schema("value string").option("recursiveFileLookup", "true").text(f"file://{tmp_path}/logs").count() == 0


def test_a_store_that_arrow_cannot_open_gets_files_through_spark():
    assert adapters.files_opened("file:///tmp/x") and adapters.files_opened("/tmp/x")
    assert not adapters.files_opened("viewfs://store/in")
