"""Session settings the library is tuned for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Times are UTC throughout. AQE sizes shuffle partitions, splits skewed join partitions and turns a join
# into a broadcast only after measuring its side.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Logs lie in many folders. By default Spark starts a task for each folder it lists, up to 10,000, each of which costs the driver
# more than the listing costs the task.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_DEFAULT = "10000"
LISTING_TASKS_PER_CORE = 4
# What one task reads, in compressed bytes. Task and finding rows shrink twenty times and more when they are written or shuffled, so that
# by Spark's defaults (128 MB of a file, 64 MB of a shuffle) a task holds more than its share of memory, and spills what it counts,
# gathers or sorts.
# A file counts for 256 KB at least: by Spark's default of 4 MB, four small files would fill a task.
READ_BYTES = {
    "spark.sql.files.maxPartitionBytes": "16MB",
    "spark.sql.files.openCostInBytes": "256KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
}
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"



def configure(spark: SparkSession) -> SparkSession:
    """Applies the settings to a running session; numbers of listing tasks and of bytes that the caller has set stay."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if spark.conf.get(LISTING_TASKS) == LISTING_DEFAULT:
        spark.conf.set(LISTING_TASKS, str(LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    given = spark.conf.getAll
    for key, value in READ_BYTES.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files when they end; a choice of the caller's stays.

    By default these files stay until the driver happens to collect its garbage, so that those of all steps of a job lie side by side.
    For writes and counts only, each of which is a query of its own: what reads a shuffle after its query has ended, as a local iterator does
    or a second ``collect`` of one frame, may find no rows there.
    """
    if SHUFFLE_CLEANUP in spark.conf.getAll:
        yield
        return
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP)
