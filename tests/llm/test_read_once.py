"""Steps of the joins over documents that are done once."""

from fleetgauge.llm.shingle_join import in_lists_of_several
from fleetgauge.llm.substrings import Units


def test_lists_of_several_need_one_shuffle_and_no_join(spark):
    rows = [(1, 10), (1, 10), (2, 10), (2, 11), (3, None), (3, 12), (4, 5), (4, 6), (4, 5)]
    kept = in_lists_of_several(spark.createDataFrame(rows, "token bigint, sid bigint"), "sid")
    assert sorted(map(tuple, kept.collect())) == [(2, 10), (2, 11), (4, 5), (4, 5), (4, 6)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 0


def test_digests_are_made_when_asked_for():
    units = Units("one two three, four five six seven eight nine ten")
    assert "digests" not in vars(units)
    assert len(units.digests) == len(units.begins) and "digests" in vars(units)
