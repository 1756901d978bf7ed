"""Where intermediate tables go.

A fold over event logs reads the parsed events several times. Parsing JSON is by far the dearest
step, so the parsed rows are written once as parquet and read back: this also cuts the lineage, and
the files outlive lost executors. The folder is the one the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.session import shuffles_dropped


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables; only a local session may fall back to a scratch folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="fleetgauge-")


def new_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses."""
    return f"{staging_root(spark)}/fleetgauge/{name}-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, path: str) -> None:
    """An empty folder, unless there is one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of staged tables that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage_table(
    df: DataFrame, name: str, *partition_by: str, row_group_bytes: int | None = None, folder: str | None = None
) -> DataFrame:
    """Writes ``df`` once, under ``folder`` if given, and returns a scan of the written table.

    Smaller row groups let a small table be read by more tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, name) if folder is None else f"{folder}/{name}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if row_group_bytes is not None:
        writer = writer.option("parquet.block.size", row_group_bytes)
    with shuffles_dropped(spark):
        writer.parquet(path)
    # partition values come back under the types they were written with
    return spark.read.schema(df.schema).parquet(path)
