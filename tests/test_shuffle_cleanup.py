"""Shuffle files go with the write that made them, and only those."""

import time

import pytest

from fleetgauge.llm.shared import written, written_in_turn
from fleetgauge.session import SHUFFLE_CLEANUP, configure, shuffles_dropped
from fleetgauge.sources.staging import stage_table
from workload.adapters import staged_rounds


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (blocks.apply(i).getName() for i in range(blocks.size())) if name.startswith("shuffle_")}


WRITERS = {
    "staged": lambda df: stage_table(df, "rows"),
    "rounds": lambda df: staged_rounds(df.sparkSession, "rows", [df]),
    "written": lambda df: written(df, "rows"),
    "in turn": lambda df: written_in_turn([df], "rows"),
}


@pytest.mark.parametrize("writer", WRITERS)
def test_no_shuffle_file_outlives_a_write(spark, writer):
    own = configure(spark.newSession())
    before = shuffle_files(own)
    kept = WRITERS[writer](own.range(10_000).repartition(7, "id"))
    # files go in the background
    until = time.monotonic() + 20
    while (left := shuffle_files(own) - before) and time.monotonic() < until:
        time.sleep(0.1)
    assert not left
    assert kept.count() == 10_000


def test_other_queries_keep_theirs(spark):
    """A local iterator reads its shuffle after the query has ended."""
    own = configure(spark.newSession())
    stage_table(own.range(10).repartition(2, "id"), "rows")
    assert SHUFFLE_CLEANUP not in own.conf.getAll
    with shuffles_dropped(own), shuffles_dropped(own):
        assert own.conf.get(SHUFFLE_CLEANUP) == "true"
    assert SHUFFLE_CLEANUP not in own.conf.getAll


def test_the_caller_may_keep_them(spark):
    own = configure(spark.newSession())
    own.conf.set(SHUFFLE_CLEANUP, "false")
    with shuffles_dropped(own):
        assert own.conf.get(SHUFFLE_CLEANUP) == "false"
    assert own.conf.get(SHUFFLE_CLEANUP) == "false"
