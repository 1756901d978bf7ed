from fleetgauge.streaming.retries import Retries, poll_logs, settled_logs, stream_session
from tests.test_retries import log_bytes
from workload import adapters


def test_the_state_has_a_partition_a_core_at_most(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "200")
    cores = spark.sparkContext.defaultParallelism
    assert stream_session(own).conf.get("spark.sql.shuffle.partitions") == str(cores)
    own.conf.set("spark.sql.shuffle.partitions", "3")
    assert stream_session(own).conf.get("spark.sql.shuffle.partitions") == "3"


def test_folds_of_a_poll_are_adaptive(spark, tmp_path):
    logs, state, seen = tmp_path / "logs", str(tmp_path / "state"), []
    logs.mkdir()
    (logs / "plain").write_bytes(log_bytes("plain"))

    def publish(fleet, part):
        settings = fleet.jobs.sparkSession.conf
        seen.append((settings.get("spark.sql.adaptive.enabled"), settings.get("spark.sql.shuffle.partitions")))

    assert poll_logs(spark, str(logs), state, publish, Retries()).awaitTermination(120)
    assert seen == [("true", spark.conf.get("spark.sql.shuffle.partitions"))]


def test_the_first_and_the_last_log_are_damaged_without_a_join(spark, tmp_path):
    rows = [("a", 0, 0, "begins"), ("a", 6, 1, "x"), ("b", 0, 0, "begins"), ("c", 0, 0, "begins"), ("c", 6, 1, "y")]
    lines = spark.createDataFrame(rows, "log_id string, phase int, ord bigint, value string")
    assert tuple(adapters.first_and_last_log(lines)) == ("a", "c")
    text = adapters.log_text(lines, "c")
    assert [tuple(r) for r in text.collect()] == [("c", "begins\ny")]
    assert "Join" not in text._jdf.queryExecution().optimizedPlan().toString()
