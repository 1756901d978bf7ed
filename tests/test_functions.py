import random

import pytest

from fleetgauge.functions import config, explain, scalars, text
from fleetgauge.thresholds import Thresholds
from tables import jobs, value_of


def python_bytes(n):
    size = float(n)
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if abs(size) < 1024:
            return f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} PB"


def test_numbers_print_like_exact_rounding(spark):
    random.seed(7)
    numbers = [0.25, 0.15, 2.5, 0.35, 1.45, 0.05, -0.04, -2.5, 0.005, 0.125, 2.675, 1e-9, 12345678.25, 99999999.95, 0.0]
    numbers += [round(random.random() * 1000, 2) for _ in range(2000)]
    numbers += [random.randint(0, 4000) / 8 for _ in range(500)]
    numbers += [random.random() * 10 ** random.randint(-4, 9) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").selectExpr(
        "x",
        *[f"{text.fixed('x', d)} AS f{d}" for d in (0, 1, 2)],
        f"{text.grouped('x', 2)} AS g",
        f"{text.round_to('x', 1)} AS r1",
        f"{text.round_to('x', 2)} AS r2",
        f"{text.format_bytes('x')} AS b",
    )
    for r in rows.collect():
        expected = (f"{r.x:.0f}", f"{r.x:.1f}", f"{r.x:.2f}", f"{r.x:,.2f}", round(r.x, 1), round(r.x, 2), python_bytes(r.x))
        assert (r.f0, r.f1, r.f2, r.g, r.r1, r.r2, r.b) == expected


def test_null_has_no_text(spark):
    null = "CAST(NULL AS double)"
    printed = (text.fixed(null, 1), text.grouped(null, 2), text.format_bytes(null), text.shortest(null))
    assert [value_of(spark, p, one=1) for p in printed] == [None] * 4


@pytest.mark.parametrize("x", [335000.0, 12000000.0, 1234.5, 0.001, 1e7 + 0.5, 0.0])
def test_shortest_text_never_uses_an_exponent(spark, x):
    assert value_of(spark, text.shortest("x"), x=x) == repr(x)


def test_quoted_list_matches_list_text(spark):
    names = ["a", "it's", 'q"x', "back\\slash"]
    df = spark.createDataFrame([(names,)], "names array<string>")
    assert df.selectExpr(text.quoted_list("names") + " AS t").first()["t"] == repr(names)


@pytest.mark.parametrize(
    "setting, megabytes",
    [
        ("4g", 4096), ("512m", 512), ("2048", 2048), ("1.5g", 1536), ("1t", 1048576), ("100k", 1), ("2048k", 2),
        ("4 GB", 4096), (" 512MB ", 512), ("", 0), ("abc", 0), ("4x", 0), ("-1g", 0),
    ],
)
def test_parse_memory(spark, setting, megabytes):
    assert value_of(spark, scalars.parse_memory_mb("v"), v=setting) == megabytes


@pytest.mark.parametrize(
    "version, code", [("3.4.1", 3004), ("2.4.8", 2004), ("3.5.0-SNAPSHOT", 3005), ("4.10", 4010), ("", None), ("x3.1", None)]
)
def test_parse_version(spark, version, code):
    assert value_of(spark, scalars.parse_spark_version("v"), v=version) == code


def test_ratios_are_zero_or_null_on_empty_input(spark):
    assert value_of(spark, scalars.gc_time_percent("gc", "run"), gc=5, run=0) == 0
    assert value_of(spark, scalars.gc_time_percent("gc", "run"), gc=1, run=4) == 25
    assert value_of(spark, scalars.memory_utilization("p", "a"), p=1, a=0) == 0
    assert value_of(spark, scalars.slot_utilization("t", "e", "c", "d"), t=10, e=0, c=4, d=100) is None
    assert value_of(spark, scalars.slot_utilization("t", "e", "c", "d"), t=800, e=2, c=4, d=100) == 100
    total = scalars.slot_utilization_total_cores("t", "e", "c", "n", "d")
    assert value_of(spark, total, t=800, e=2, c=1, n=8, d=100) == 100
    assert value_of(spark, total, t=100, e=2, c=1, n=0, d=100) == 50
    assert value_of(spark, total, t=0, e=2, c=1, n=8, d=100) is None


@pytest.mark.parametrize("total, target, partitions", [(0, 128, 1), (1, 128, 1), (2**27, 128, 1), (2**27 + 1, 128, 2), (10 * 2**30, 64, 160)])
def test_optimal_partitions_rounds_up(spark, total, target, partitions):
    assert value_of(spark, scalars.optimal_partitions("total", target), total=total) == partitions


def test_typed_config_defaults_and_bad_values(spark):
    given = {
        "spark.executor.cores": "x",
        "spark.sql.shuffle.partitions": " 400 ",
        "spark.sql.autoBroadcastJoinThreshold": "10MB",
        "spark.sql.adaptive.enabled": "TRUE",
    }
    empty, set_ = config.typed_config(jobs(spark, [{"app_id": "e"}, {"app_id": "s", "config": given}])).orderBy("app_id").collect()
    assert (empty.executor_memory, empty.executor_cores, empty.shuffle_partitions) == ("1g", 1, 200)
    assert (empty.aqe_enabled, empty.aqe_explicit, empty.broadcast_threshold) == (False, False, 10485760)
    assert empty.serializer.endswith("JavaSerializer") and empty.driver_memory == "1g" and empty.min_executors == ""
    assert (set_.executor_cores, set_.shuffle_partitions, set_.broadcast_threshold) == (1, 400, 10 * 2**20)
    assert (set_.aqe_enabled, set_.aqe_explicit) == (True, True)


@pytest.mark.parametrize(
    "key, category",
    [
        ("spark.executor.memory", "Executor"),
        ("spark.driver.cores", "Executor"),
        ("spark.sql.shuffle.partitions", "Shuffle & Partitioning"),
        ("spark.reducer.maxSizeInFlight", "Shuffle & Partitioning"),
        ("spark.sql.autoBroadcastJoinThreshold", "SQL & AQE"),
        ("spark.dynamicAllocation.enabled", "Dynamic Allocation"),
        ("spark.kryo.registrator", "Serialization"),
        ("spark.memory.fraction", "Memory"),
        ("spark.app.name", "Other"),
    ],
)
def test_category(spark, key, category):
    assert value_of(spark, config.category_of("k"), k=key) == category


@pytest.mark.parametrize(
    "metric, value, start",
    [
        ("gc_time_percent", 19.9, "**Healthy"),
        ("gc_time_percent", 20.0, "**Warning"),
        ("gc_time_percent", 40.0, "**Critical"),
        ("spill_to_disk_bytes", 2.0**30, "**Critical"),
        ("memory_utilization_percent", 80.0, "**Warning"),
        ("task_count", 5.0, ""),
    ],
)
def test_assessment_limits_are_inclusive(spark, metric, value, start):
    sentence = value_of(spark, explain.assess_metric("m", "v"), m=metric, v=value)
    assert sentence.startswith(start) and bool(sentence) == bool(start)


def test_explanation_of_known_and_unknown_metrics(spark):
    df = spark.createDataFrame([("input_bytes", 3.0 * 2**20), ("nope", 1.0)], "metric_name string, value double")
    known, unknown = explain.explain_metric(df).orderBy("metric_name").collect()
    assert known.formatted_value == "3.0 MB" and known.known and "### Assessment" not in known.explanation
    assert not unknown.known and unknown.explanation.startswith("Unknown metric: `nope`. Known metrics: `data_skew_ratio`")


def test_threshold_override_keeps_other_defaults():
    t = Thresholds.from_json('{"skew_warning_ratio": 3.0, "unknown": 1}')
    assert t.skew_warning_ratio == 3.0 and t.gc_warning_percent == 20.0
    with pytest.raises(AttributeError):
        t.skew_warning_ratio = 1.0
