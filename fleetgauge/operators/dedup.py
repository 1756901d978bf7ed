"""The table of processed keys (application ids or log paths): ``key``, ``processed_at``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_new(candidates: DataFrame, processed: DataFrame) -> DataFrame:
    """Candidates (column ``key``, any others kept) not processed yet."""
    return candidates.join(processed.select("key"), "key", "left_anti")


def mark_processed(processed: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """The table with ``keys`` added under ``now``; a key already there keeps its first stamp."""
    added = keys.select("key", now.cast("timestamp").alias("processed_at"))
    both = processed.select("key", "processed_at").unionByName(added)
    return both.groupBy("key").agg(F.min("processed_at").alias("processed_at"))


def evict_processed(processed: DataFrame, cap: int | None = None) -> DataFrame:
    """The newest ``cap`` keys, or all of them without a cap: an evicted key is picked up again.

    Every task keeps at most ``cap`` rows for the final merge.
    """
    if cap is None:
        return processed
    return processed.orderBy(F.desc("processed_at"), "key").limit(cap)


def filter_new_and_mark(
    candidates: DataFrame, processed: DataFrame, now: Column, cap: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """New candidates, and the table after marking them and, under a cap, evicting the oldest."""
    new = filter_new(candidates, processed)
    return new, evict_processed(mark_processed(processed, new, now), cap)


def retry_failed(processed: DataFrame, failed: DataFrame) -> DataFrame:
    """The table without the failed keys, so that they are picked up again."""
    return processed.join(failed.select("key"), "key", "left_anti")
