"""Wording of the findings.

``{slot}`` is filled per finding from the slots of its case, ``$name`` once from the thresholds.
"""

from __future__ import annotations

from string import Template
from typing import NamedTuple


class Texts(NamedTuple):
    title: str
    message: str
    current_value: str
    recommended_value: str
    estimated_impact: str

    def given(self, **limits) -> "Texts":
        """The same texts with ``$name`` filled in."""
        return Texts(*[Template(text).safe_substitute(limits) for text in self])


# The texts of every outcome of every rule, in report order.
DATA_SKEW = Texts(
    "Data skew in Stage {stage_id}",
    "Max task duration ({x:float}ms) is {value:.1f}x the median ({y:float}ms)",
    "skew ratio {value:.1f}x",
    "Enable AQE: spark.sql.adaptive.enabled=true, spark.sql.adaptive.skewJoin.enabled=true",
    "Stage {stage_id} duration could decrease ~{n}%",
)
DATA_SKEW_DESPITE_AQE = "AQE is enabled but skew persists — consider salting the join key"
SPILL_TO_DISK = Texts(
    "Disk spill in Stage {stage_id}",
    "{value:.1f} GB spilled to disk — data doesn't fit in memory",
    "{value:.1f} GB spill",
    "Increase spark.executor.memory or spark.sql.shuffle.partitions",
    "Eliminating spill can speed up stage 2-10x",
)
GC_PRESSURE = Texts(
    "High GC pressure in Stage {stage_id}",
    "GC time is {value:.0f}% of total task time",
    "{value:.0f}% GC time",
    "Increase executor memory or reduce data cached per task",
    "Reducing GC to <$target% could save ~{n}% stage time",
)
TOO_FEW_PARTITIONS = Texts(
    "Suboptimal shuffle partition count",
    "Too few partitions: {n} for {x:.1f} GB shuffle",
    "spark.sql.shuffle.partitions = {n}",
    "spark.sql.shuffle.partitions = {k}",
    "Better partition sizing reduces spill and improves parallelism",
)
TOO_FEW_PARTITIONS_WITH_AQE = TOO_FEW_PARTITIONS._replace(
    message="Too few partitions: {n} for {x:.1f} GB shuffle (AQE may handle partition coalescing automatically)"
)
TOO_MANY_PARTITIONS = TOO_FEW_PARTITIONS._replace(message="Too many partitions: {n} for {x:.1f} GB shuffle")
EXECUTOR_IDLE = Texts(
    "Executor over-provisioning",
    "Slot utilization is only {value:.0f}% — {x:.0f}% idle",
    "{n} executors x {k} cores, {value:.0f}% utilized",
    "Reduce executor count or increase parallelism",
    "Right-sizing can reduce costs 30-50% (note: sequential stages reduce measured utilization)",
)
TASK_FAILURES = Texts(
    "Task failures in Stage {stage_id}",
    "{n} of {k} tasks failed",
    "{n} failed tasks",
    "Check executor logs for OOM or fetch failures",
    "",
)
SMALL_FILES = Texts(
    "Small input partitions in Stage {stage_id}",
    "Input per task is {x:.1f} MB across {n} tasks",
    "{x:.1f} MB/task, {n} tasks",
    "Use coalesce() or increase spark.sql.files.maxPartitionBytes",
    "Reducing task count cuts scheduler overhead and improves throughput",
)
BROADCAST_DISABLED = Texts(
    "Broadcast join disabled",
    "spark.sql.autoBroadcastJoinThreshold is -1 (disabled)",
    "disabled (-1)",
    "spark.sql.autoBroadcastJoinThreshold = $default",
    "Broadcasting small tables avoids expensive shuffle joins",
)
BROADCAST_LOW = Texts(
    "Low broadcast join threshold",
    "Threshold is {x:.0f} MB — some shuffle joins might be avoidable",
    "{x:.0f} MB",
    "spark.sql.autoBroadcastJoinThreshold = $default ($default_mb MB)",
    "Larger threshold may convert shuffle joins to broadcast joins",
)
JAVA_SERIALIZER = Texts(
    "Using default Java serializer",
    "Current serializer: {s}",
    "{s}",
    "spark.serializer = org.apache.spark.serializer.KryoSerializer",
    "Kryo serialization is typically 10x faster and more compact",
)
ALLOCATION_UNBOUNDED = Texts(
    "Dynamic allocation without bounds",
    "Dynamic allocation enabled but {s} not set",
    "spark.dynamicAllocation.enabled = true",
    "{s2}",
    "Unbounded dynamic allocation can over-provision resources",
)
ALLOCATION_SUGGESTED = Texts(
    "Consider enabling dynamic allocation",
    "Slot utilization is {value:.0f}% with fixed executor count",
    "{n} static executors, {value:.0f}% utilized",
    "spark.dynamicAllocation.enabled = true",
    "Dynamic allocation auto-scales executors to match workload",
)
MEMORY_PRESSURE = Texts(
    "Executor memory pressure detected",
    "High GC ({value:.0f}% in hottest stage) with {x:.0f}% memory utilization",
    "memoryOverhead = {s}",
    "Increase spark.executor.memory to reduce heap GC pressure,"
    " or spark.executor.memoryOverhead if seeing container OOM kills",
    "Reducing memory pressure prevents GC thrashing and container OOM kills",
)
DEFAULT_OVERHEAD = "default (max(384MB, 10%))"
DRIVER_TOO_SMALL = Texts(
    "Driver memory too low",
    "Driver memory is too low: {s} ({n} MB) — risk of OOM",
    "spark.driver.memory = {s}",
    "spark.driver.memory >= ${limit}m",
    "Insufficient driver memory causes OOM on collect/broadcast operations",
)
DRIVER_SMALL_FOR_CLUSTER = Texts(
    "Driver memory insufficient for large cluster",
    "Driver memory {s} may be insufficient for cluster with {k} executors",
    "spark.driver.memory = {s}",
    "spark.driver.memory >= ${limit}m",
    "Large clusters need more driver memory for coordination and metadata",
)
DRIVER_TOO_LARGE = Texts(
    "Driver memory too high",
    "Driver memory is too high: {s} ({n} MB) — resource waste",
    "spark.driver.memory = {s}",
    "spark.driver.memory <= ${limit}m",
    "Over-provisioned driver wastes cluster resources",
)
MEMORY_UNUSED = Texts(
    "Executor memory underutilized",
    "Peak memory usage is only {value:.0f}% of allocated — executors overprovisioned",
    "{value:.0f}% memory utilization",
    "Reduce spark.executor.memory to match actual usage + 20% buffer",
    "Right-sizing executor memory frees cluster resources",
)
AQE_DISABLED = Texts(
    "AQE explicitly disabled",
    "Adaptive Query Execution is disabled (enabled by default since Spark 3.2)",
    "spark.sql.adaptive.enabled = false",
    "spark.sql.adaptive.enabled = true",
    "AQE auto-handles partition coalescing, skew joins, and broadcast threshold",
)
AQE_NOT_ENABLED = AQE_DISABLED._replace(
    title="AQE not enabled",
    message="Consider enabling Adaptive Query Execution for automatic optimization",
)
STAGES_REPEATED = Texts(
    "Stages re-executed",
    "Stages re-executed: {s} — add .persist() to avoid recomputation",
    "{n} duplicate stage names",
    "Use .persist() or .cache() on reused DataFrames",
    "Shorter lineage reduces recomputation risk and planning overhead",
)
SHUFFLE_RATIO = Texts(
    "High shuffle volume in Stage {stage_id}",
    "Stage writes {x:.1f} GB shuffle data ({value:.1f}x of input) — consider pre-partitioning or bucketing",
    "{x:.1f} GB shuffle write, {value:.1f}x input ratio",
    "Use bucketing, pre-partition data, or reduce shuffle with broadcast joins",
    "Reduce disk I/O and network transfer",
)
SHUFFLE_VOLUME = SHUFFLE_RATIO._replace(
    message="Stage writes {value:.1f} GB shuffle data — consider pre-partitioning or bucketing",
    current_value="{value:.1f} GB shuffle write",
)
INPUT_SKEW = Texts(
    "Input data skew in Stage {stage_id}",
    "Max task input ({x:bytes}) is {value:.1f}x the median ({y:bytes})",
    "input skew ratio {value:.1f}x",
    "Repartition input data or use salting to distribute evenly",
    "Stage {stage_id} tasks could run ~{n}% faster",
)
