from fleetgauge.llm.shared import smallest_reachable


def test_components_of_chains_stars_and_cycles(spark):
    chain = [(i, i + 1) for i in range(10, 60)]
    star = [(100, 100 + i) for i in range(1, 200)]
    cycle = [(300, 301), (301, 302), (302, 300), (302, 302), (None, 300)]
    found = dict(map(tuple, smallest_reachable(spark.createDataFrame(chain + star + cycle, "a long, b long")).collect()))
    assert {found[i] for i in range(10, 61)} == {10}
    assert {found[i] for i in range(100, 300)} == {100}
    assert {found[i] for i in range(300, 303)} == {300} and len(found) == 51 + 200 + 3


def test_no_links_no_components(spark):
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).collect() == []
