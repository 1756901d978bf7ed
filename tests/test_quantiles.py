import random

import pytest

from fleetgauge.operators.metrics import stage_quantiles, stage_rollup, stage_totals
from fleetgauge.operators.quantiles import exact_quantiles, rank_goals

COLUMNS = (
    "run_ms", "gc_ms", "shuffle_read_bytes", "shuffle_write_bytes", "spill_disk_bytes", "spill_memory_bytes",
    "input_records", "output_records", "shuffle_read_records", "shuffle_write_records",
)


def expected(values):
    s = sorted(values)

    def at(p):
        position = p * (len(s) - 1)
        low = int(position)
        high = min(low + 1, len(s) - 1)
        return float(int(s[low] + (position - low) * (s[high] - s[low])))

    return tuple(at(p) for p in (0, 0.25, 0.5, 0.75, 1))


def groups():
    random.seed(3)
    return {
        0: [5],
        1: [1, 2],
        2: [7] * 40,
        3: [random.randint(0, 5000) for _ in range(301)],
        4: [random.randint(-10**6, 10**12) for _ in range(500)],
        5: [0] * 333 + [random.randint(4000, 5000) for _ in range(333)],
        6: [random.randint(-9, 9) for _ in range(100)],
        7: [2**k + d for k in range(3, 40) for d in (-1, 0, 1)],
    }


def task_table(spark):
    rows = [("a", stage, v) for stage, values in groups().items() for v in values]
    base = spark.createDataFrame(rows, "app_id string, stage_id bigint, duration_ms bigint")
    zeros = [f"0L AS {c}" for c in COLUMNS if c != "run_ms"]
    return base.selectExpr("*", "duration_ms AS run_ms", *zeros, "false AS failed", "duration_ms > 0 AS killed").repartition(5)


@pytest.mark.parametrize("digits", [128, 5, 1])
def test_selection_is_exact(spark, digits):
    rows = stage_quantiles(task_table(spark), digits=digits).collect()
    assert {r.stage_id: tuple(r.executor_run_time) for r in rows} == {s: expected(v) for s, v in groups().items()}
    assert all(tuple(r.duration) == tuple(r.executor_run_time) for r in rows)
    assert {tuple(r.jvm_gc_time) for r in rows} == {(0.0,) * 5}


def test_rollup_carries_totals(spark):
    tasks = task_table(spark)
    rows = {r.stage_id: r for r in stage_rollup(tasks).collect()}
    for stage, values in groups().items():
        assert (rows[stage].task_count, rows[stage].sum_run_ms) == (len(values), sum(values))
        assert rows[stage].killed_tasks == sum(v > 0 for v in values)
    assert stage_totals(tasks).count() == len(groups())


def test_extreme_values_nulls_and_tasks_without_a_stage(spark):
    top, bottom = 2**63 - 1, -(2**63)
    values = [top, top - 1, top - 2, bottom, bottom + 1, bottom + 2, 0, None, None]
    rows = [("a", 1, v) for v in values] + [("a", 2, None), ("a", None, 5), (None, 1, 5)]
    tasks = spark.createDataFrame(rows, "app_id string, stage_id bigint, v bigint")
    found = exact_quantiles(tasks, ["app_id", "stage_id"], {"v": "v"}).selectExpr("stage_id", "v[0]", "v[2]", "v[4]").collect()
    assert [tuple(r) for r in found] == [(1, bottom, 0, top)]


def test_the_tasks_are_read_twice(spark, tmp_path):
    task_table(spark).write.parquet(str(tmp_path / "tasks"))
    found = stage_quantiles(spark.read.parquet(str(tmp_path / "tasks")), digits=1)
    found.collect()
    ran = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ran.count("FileScan") == 2 and "ReusedExchange" in ran
    scans = [line for line in ran.splitlines() if "FileScan" in line]
    assert all("spill" not in line for line in scans)
    assert "percentile" not in ran


def spread(spark, counts):
    """Tasks of many stages, dealt over partitions in no order."""
    rows = [("a" if i % 3 else "b", stage, (i * 7919) % 1009) for stage, n in enumerate(counts) for i in range(n)]
    random.seed(4)
    random.shuffle(rows)
    tasks = spark.createDataFrame(rows, "app_id string, stage_id bigint, v bigint")
    return tasks.selectExpr("*", "-v AS w").repartition(6)


@pytest.mark.parametrize("batch", ["7", "10000"])
@pytest.mark.parametrize("digits", [16, 1])
def test_stages_that_span_batches_and_partitions(spark, batch, digits):
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    tasks = spread(own, [1, 2, 3, 900, 40, 500, 1])
    values = {}
    for r in tasks.collect():
        values.setdefault((r.app_id, r.stage_id), []).append(r.v)
    found = exact_quantiles(tasks, ["app_id", "stage_id"], {"v": "v", "w": "w"}, digits).collect()
    assert {(r.app_id, r.stage_id): tuple(map(float, r.v)) for r in found} == {k: expected(v) for k, v in values.items()}
    # truncated towards zero on both sides
    assert all(list(r.w) == [-x for x in reversed(r.v)] for r in found)


def test_values_reach_the_shuffle_gathered_not_one_by_one(spark):
    tasks = spread(spark, [200, 300, 50])
    goals = rank_goals(tasks, ["app_id", "stage_id"], {"v": "v", "w": "w"}, 1)
    assert goals.count() == 6
    plan = goals._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Window" not in plan
