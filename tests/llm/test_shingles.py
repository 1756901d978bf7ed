import random

import pytest

from fleetgauge.llm import shingle_join
from fleetgauge.llm.shingle_join import shingle_components


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} - {()}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= 90 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", range(3))
def test_components_agree_with_brute_force(spark, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", " \t\n", "one", "ONE", "One two", "one two", "a\x0bb\x0cc d", "a b c D", "É b c", "é b c", "x" * 5000]
    for group in range(12):
        base = draw.choices(vocabulary, k=draw.choice([3, 12, 40, 150]))
        for _ in range(draw.choice([1, 2, 25])):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 25)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(draw.choice([" ", "  ", "\n"]).join(copy))
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    assert {tuple(r) for r in shingle_components(table, bits=10).collect()} == brute(rows)


def test_no_documents_null_and_repeated_ids(spark, empty):
    assert shingle_components(empty("doc_id long, text string")).collect() == []
    rows = [(7, "a b c d"), (7, "a b c d"), (9, "a b c d"), (None, "q r s"), (3, None)]
    found = shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r[0] or 0), r[1], r[2]) for r in found) == [(0, 1, None), (3, 0, 3), (7, 2, 7), (7, 2, 7), (9, 2, 7)]


@pytest.mark.parametrize("rows", [512, 3])
def test_a_cloud_of_similar_sets_that_do_not_link(spark, monkeypatch, rows):
    """Sets that share their rarest shingles, a few of them linked: lists without a head that settles them."""
    monkeypatch.setattr(shingle_join, "LIST_ROWS", rows)
    monkeypatch.setattr(shingle_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(shingle_join, "CARRIED_TOKENS", 2 if rows == 3 else 64)
    draw = random.Random(rows)
    passage = [f"rare{i}" for i in range(40)]
    texts = []
    for k in range(90):
        own = [f"own{k}x{i}" for i in range(draw.choice([8, 9, 10, 30]))]
        texts.append(" ".join([*passage, *own]))
        if k % 9 == 0:
            texts.append(" ".join([*passage, *own[:-1], "end"]))
    for k in range(40):  # a chain: each links with the next only
        texts.append(" ".join(f"chain{i}" for i in range(3 * k, 3 * k + 80)))
    draw.shuffle(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in shingle_components(table, bits=10).collect()} == brute(list(enumerate(texts)))
