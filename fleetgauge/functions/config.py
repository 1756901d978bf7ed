"""Typed reads of a ``map<string,string>`` of Spark properties, and its categorisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import parse_byte_size
from fleetgauge.functions.text import array_of, literal

# Display categories with the key prefixes that belong to them, first match wins.
CATEGORIES = (
    ("Executor", ("spark.executor.", "spark.driver.")),
    ("Shuffle & Partitioning", ("spark.sql.shuffle.", "spark.shuffle.", "spark.reducer.")),
    ("SQL & AQE", ("spark.sql.adaptive.", "spark.sql.autoBroadcast", "spark.sql.files.")),
    ("Dynamic Allocation", ("spark.dynamicAllocation.",)),
    ("Serialization", ("spark.serializer", "spark.kryoserializer.", "spark.kryo.")),
    ("Memory", ("spark.memory.",)),
)
OTHER_CATEGORY = "Other"

# The properties shown in a configuration snapshot.
SNAPSHOT_KEYS = (
    "spark.executor.memory",
    "spark.executor.memoryOverhead",
    "spark.executor.cores",
    "spark.executor.instances",
    "spark.driver.memory",
    "spark.driver.cores",
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.adaptive.coalescePartitions.enabled",
    "spark.sql.autoBroadcastJoinThreshold",
    "spark.dynamicAllocation.enabled",
    "spark.dynamicAllocation.minExecutors",
    "spark.dynamicAllocation.maxExecutors",
    "spark.serializer",
    "spark.default.parallelism",
    "spark.memory.fraction",
    "spark.memory.storageFraction",
    "spark.sql.files.maxPartitionBytes",
    "spark.speculation",
    "spark.shuffle.compress",
    "spark.io.compression.codec",
)


def setting(key: str, default: str = "", config: str = "config") -> str:
    return f"coalesce(try_element_at({config}, {literal(key)}), {literal(default)})"


def _integer(key: str, default: int, config: str) -> str:
    """Integer property; a malformed value counts as unset."""
    return f"coalesce(try_cast(trim(try_element_at({config}, {literal(key)})) AS bigint), {default}L)"


def _flag(key: str, config: str) -> str:
    return f"(lower({setting(key, 'false', config)}) = 'true')"


def config_accessors(config: str = "config") -> dict[str, str]:
    """Every typed property by name, with Spark's default where the key is unset."""
    broadcast = parse_byte_size(f"try_element_at({config}, 'spark.sql.autoBroadcastJoinThreshold')")
    return {
        "executor_memory": setting("spark.executor.memory", "1g", config),
        "executor_cores": _integer("spark.executor.cores", 1, config),
        "shuffle_partitions": _integer("spark.sql.shuffle.partitions", 200, config),
        "dynamic_allocation": _flag("spark.dynamicAllocation.enabled", config),
        "aqe_enabled": _flag("spark.sql.adaptive.enabled", config),
        "aqe_explicit": f"coalesce(map_contains_key({config}, 'spark.sql.adaptive.enabled'), false)",
        "serializer": setting("spark.serializer", "org.apache.spark.serializer.JavaSerializer", config),
        "broadcast_threshold": f"coalesce({broadcast}, 10485760L)",
        "min_executors": setting("spark.dynamicAllocation.minExecutors", "", config),
        "max_executors": setting("spark.dynamicAllocation.maxExecutors", "", config),
        "executor_memory_overhead": setting("spark.executor.memoryOverhead", "", config),
        "driver_memory": setting("spark.driver.memory", "1g", config),
        "driver_memory_overhead": setting("spark.driver.memoryOverhead", "", config),
    }


def typed_config(jobs: DataFrame, by: str = "app_id") -> DataFrame:
    """One row per job with every typed property as a column."""
    return jobs.selectExpr(by, *[f"{expression} AS {name}" for name, expression in config_accessors().items()])


def category_rank(key: str) -> str:
    """Position of the key's category in the report."""
    tests = [
        " OR ".join(f"startswith({key}, {literal(prefix)})" for prefix in prefixes) for _, prefixes in CATEGORIES
    ]
    cases = " ".join(f"WHEN {test} THEN {i}" for i, test in enumerate(tests))
    return f"CASE {cases} ELSE {len(CATEGORIES)} END"


def category_of(key: str) -> str:
    """Display category of a property name."""
    names = array_of(literal(name) for name in (*[name for name, _ in CATEGORIES], OTHER_CATEGORY))
    return f"get({names}, {category_rank(key)})"


def config_category(jobs: DataFrame, by: str = "app_id") -> DataFrame:
    """One row per property: category, its report position, key and value."""
    entries = jobs.selectExpr(by, "explode(config) AS (key, value)")
    return entries.selectExpr(
        by, f"{category_rank('key')} AS category_rank", f"{category_of('key')} AS category", "key", "value"
    )


def config_snapshot(jobs: DataFrame, by: str = "app_id") -> DataFrame:
    """The important properties that are set to a non-empty value."""
    entries = jobs.selectExpr(by, "explode(config) AS (key, value)")
    return entries.filter(F.col("key").isin(*SNAPSHOT_KEYS) & (F.col("value") != ""))
