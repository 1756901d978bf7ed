"""Small hand-written stage and job tables."""

from fleetgauge.functions.text import literal
from fleetgauge.operators.metrics import distributions
from fleetgauge.schemas import EXECUTOR_COLUMNS

MIB, GIB = 2**20, 2**30

STAGE_DEFAULTS = {
    "app_id": "a",
    "stage_id": 0,
    "stage_name": "stage",
    "task_count": 100,
    "sum_run_ms": 100_000,
    "gc_ms": 5_000,
    "shuffle_read_bytes": 100 * MIB,
    "shuffle_write_bytes": 50 * MIB,
    "spill_disk_bytes": 0,
    "spill_memory_bytes": 0,
    "failed_tasks": 0,
    "killed_tasks": 0,
    "input_bytes": 2_000 * MIB,
    "input_records": 0,
    "output_bytes": 50 * MIB,
    "output_records": 0,
    "shuffle_read_records": 0,
    "shuffle_write_records": 0,
    "run_median": 1000.0,
    "run_max": 2000.0,
    "in_median": 0.0,
    "in_max": 0.0,
}
JOB_DEFAULTS = {"app_id": "a", "app_name": "job", "spark_version": "3.4.0", "duration_ms": 300_000, "config": {}}


def stages(spark, rows):
    """Stage table from partial rows; quantiles are given as medians and maxima."""
    full = [{**STAGE_DEFAULTS, **row} for row in rows]
    columns = list(STAGE_DEFAULTS)
    kinds = {str: "string", int: "bigint", float: "double"}
    schema = ", ".join(f"{c} {kinds[type(STAGE_DEFAULTS[c])]}" for c in columns)
    flat = spark.createDataFrame([tuple(row[c] for c in columns) for row in full], schema)

    def quantiles(median, top):
        return f"named_struct('min', 0D, 'p25', 0D, 'median', {median}, 'p75', {median}, 'max', {top})"

    dist = distributions(
        {
            "executor_run_time": quantiles("run_median", "run_max"),
            "input_metrics.bytes": quantiles("in_median", "in_max"),
        }
    )
    return flat.selectExpr("*", f"{dist} AS dist")


def jobs(spark, rows):
    """Job table from partial rows; ``ex_*`` columns are null unless given."""
    full = [{**JOB_DEFAULTS, **row} for row in rows]
    columns = [*JOB_DEFAULTS, *EXECUTOR_COLUMNS]
    schema = "app_id string, app_name string, spark_version string, duration_ms bigint, config map<string,string>, "
    schema += ", ".join(f"{c} bigint" for c in EXECUTOR_COLUMNS)
    return spark.createDataFrame([tuple(row.get(c) for c in columns) for row in full], schema)


def executors(count=10, peak=2 * GIB, allocated=4 * GIB, task_ms=500_000, cores=0):
    sums = {c: 0 for c in EXECUTOR_COLUMNS}
    return {**sums, "ex_count": count, "ex_peak_mem": peak, "ex_alloc_mem": allocated, "ex_task_ms": task_ms, "ex_cores": cores}


def value_of(spark, expression, **columns):
    """One SQL expression over literal columns."""

    def render(value):
        return literal(value) if isinstance(value, str) else f"{value!r}{'D' if isinstance(value, float) else 'L'}"

    row = spark.range(1).selectExpr(*[f"{render(value)} AS {name}" for name, value in columns.items()])
    return row.selectExpr(f"{expression} AS result").first()["result"]
