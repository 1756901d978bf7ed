"""Units of work in rounds: the same links, and no more of the units at a time than asked for."""

import numpy as np
import pytest

from fleetgauge.llm import vectors
from fleetgauge.llm.shared import configure

SCHEMA = "label int, vec_id long, code long"


@pytest.fixture
def coded(spark):
    draw = np.random.default_rng(5)
    codes = draw.integers(-(2**63), 2**63, 40)
    # a common code and near copies of it, and others
    rows = [(i % 2, i, int(codes[0]) ^ (1 << i % 3)) for i in range(60)] + [(i % 2, 60 + i, int(c)) for i, c in enumerate(codes)]
    return configure(spark).createDataFrame(rows, SCHEMA)


def test_rounds_deal_every_meeting_once(spark, coded):
    sizes = vectors.bucket_sizes(coded, 4)
    whole = sorted(vectors.meetings(coded, sizes, 4).collect())
    assert sizes.agg({"members": "sum"}).first()[0] == len(whole)
    rounds = vectors.Rounds.of(sizes, -(-len(whole) // 6))
    assert rounds.count >= 6 and rounds.wide
    dealt = [vectors.meetings(coded, sizes, 4, rounds, n).collect() for n in range(rounds.count)]
    assert sorted(row for part in dealt for row in part) == whole
    # the common code alone has most meetings, and is in all rounds
    assert max(map(len, dealt)) < len(whole) / 3


def test_sizes_count_who_is_there(spark, coded):
    homes = vectors.at_home(coded)
    here = {}
    for row in homes.unionByName(vectors.visits(homes)).collect():
        here.setdefault((row.label, row.tab, row.part), []).append(row.vec_id)
    own = {(r.label, r.tab, r.part) for r in homes.collect()}
    expected = {key: -(-len(ids) // 4) for key, ids in here.items() if key in own and len(ids) > 1}
    assert {(r.label, r.tab, r.part): r.right_blocks for r in vectors.bucket_sizes(coded, 4).collect()} == expected


def test_links_in_rounds_are_those_of_one_round(spark):
    draw = np.random.default_rng(3)
    rows = []
    for group in range(6):
        base = draw.normal(size=64)
        rows += [(10 * group + k, (base + draw.normal(size=64) * 0.05).tolist(), 1) for k in range(10)]
    rows.append((70, rows[5][1], 1))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(vectors.near_vectors(table, block_rows=4).collect())
    assert sorted(vectors.near_vectors(table, block_rows=4, round_bytes=500_000).collect()) == whole
    assert sum(r.n_links for r in whole) > 300
