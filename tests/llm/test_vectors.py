import numpy as np
import pytest

from fleetgauge.llm.vectors import near_vectors


def brute(rows, cosine=0.93):
    linked = {i: set() for i, _, _ in rows}
    units = {}
    for i, v, label in rows:
        v = None if v is None or any(x is None for x in v) else np.array(v, float)
        if v is not None and len(v) and label is not None and np.isfinite(v).all() and v.any():
            units[i] = (v / np.linalg.norm(v), label)
    for i, (x, a) in units.items():
        for j, (y, b) in units.items():
            if i != j and a == b and len(x) == len(y) and x @ y >= cosine:
                linked[i].add(j)
    component = {}
    for i in sorted(linked):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component[i] = min(seen)
    return {(i, len(linked[i]), component[i], component[i] == i) for i in linked}


def test_near_vectors_agree_with_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = []
    for group in range(30):
        base = draw.normal(size=64)
        for k in range(1 + group % 7 * 3):
            rows.append((len(rows), (base + draw.normal(size=64) * 0.05).astype("float32").tolist(), group % 3))
    rows.append((len(rows), rows[5][1], rows[5][2]))  # an exact copy
    rows.append((len(rows), [x * 1e-20 for x in rows[5][1]], rows[5][2]))
    rows.append((len(rows), rows[5][1], None))
    for odd in (None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 3, [1.0] * 3):
        rows.append((len(rows), odd, 1))
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")
    for block_rows in (256, 4):
        assert {tuple(r) for r in near_vectors(table, block_rows=block_rows).collect()} == brute(rows)


def test_no_vectors_and_repeated_ids(spark, empty):
    assert near_vectors(empty("vec_id long, embedding array<float>, label int")).collect() == []
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in found) == [(0, 0, None), (1, 1, 1), (1, 1, 1), (2, 0, 2)]


@pytest.mark.parametrize("shared", [0.0, 0.7])
def test_links_near_the_threshold_are_found_with_and_without_a_common_mean(spark, shared):
    draw = np.random.default_rng(8)
    mean = np.eye(64)[0] * np.sqrt(shared)
    rows = []
    for cosine in np.repeat([0.9301, 0.94, 0.95, 0.96], 150):
        base, away = np.linalg.qr(draw.normal(size=(63, 2)))[0].T * np.sqrt(1 - shared)
        turn = (cosine - shared) / (1 - shared)
        for rest in (base, turn * base + np.sqrt(1 - turn**2) * away):
            rows.append((len(rows), (mean + np.concatenate([[0.0], rest])).tolist(), 1))
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    units = np.array([v for _, v, _ in rows])
    links = (units @ units.T >= 0.93).sum() - len(rows)
    assert 0.9 * links <= sum(r.n_links for r in found) <= links
