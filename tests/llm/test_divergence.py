import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetgauge.llm import divergence as D

FIELDS = "lang string, source string, text string"


def plain(rows, least=30, top=50):
    spread, counts, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        groups.add((lang, source))
        spread.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for x, t in spread if x == lang and spread[x, t] >= least]
        sources = [s for x, s in groups if x == lang]

        def p(n, total):
            return 1 + 10**9 * (n + 5) // (total + 5 * len(kept))

        sums = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        share = {s: {t: p(counts[lang, s, t], sums[s]) for t in kept} for s in sources}
        whole = {t: p(sum(counts[lang, s, t] for s in sources), sum(sums.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(share[s][t] - share[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, share[s][t] - whole[t]) for t in kept if counts[lang, s, t] and share[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("tile, block", [(64, 20_000), (2, 7), (1, 1)])
def test_agrees_with_plain_counts(spark, tile, block):
    draw = random.Random(tile)
    vocabulary = [f"{x}{y}" for x in "abcdefgh" for y in ("", "é", "Z", "日")]
    rows = [
        (draw.choice(["en", "de", None, ""]), draw.choice(["x", "y", "é", None, "z"]), " ".join(draw.choices(vocabulary[: draw.choice([5, 32])], k=9)))
        for _ in range(150)
    ]
    rows += [("no", "a", None), ("no", "b", ""), ("no", "c", "1 2 3"), ("one", "a", "q"), ("en", "bare", "12"), ("en", "x", "w" * 100_000)]
    rows += rows[:20]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], f"{FIELDS}, row int, part string").repartition(3)
    found = D.audit_sources(table, min_documents=4, top_terms=3, tile_groups=tile, block_cells=block)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 4, 3)


def test_empty_table(spark, empty):
    assert D.audit_sources(empty(FIELDS)).collect() == []


def test_partial_counts_are_handed_on(spark, monkeypatch):
    rows = [("en", "x", "a b a"), ("en", "y", "b"), ("en", "x", None)]
    found = D.term_counts(spark.createDataFrame(rows, FIELDS)).groupBy("source", "term").sum("n", "n_docs").collect()
    assert {(r[0], r[1], r[2], r[3]) for r in found if r[1]} == {("x", "a", 2, 1), ("x", "b", 1, 1), ("y", "b", 1, 1)}


def test_shares_are_exact_beyond_64_bit_products():
    counts, totals = np.array([0, 7 * 10**12, 3, 10**15]), np.array([25, 9 * 10**14, 11, 10**15 + 5])
    assert D.shares(counts, totals).tolist() == [1 + 10**9 * (int(n) + 5) // int(t) for n, t in zip(counts, totals)]
    with pytest.raises(ValueError):
        D.shares(np.array([1]), np.array([1 << 60]))


@pytest.mark.parametrize("seed", range(15))
def test_tree_walk_agrees_with_whole_matrix(seed):
    draw = np.random.default_rng(seed)
    rows, width = int(draw.integers(1, 9)), int(draw.integers(1, 40))
    counts = draw.integers(0, 5, (rows, width)) * (draw.random((rows, width)) < draw.choice([0.0, 0.1, 0.9]))
    totals = counts.sum(axis=1) + 5 * width
    whole = np.stack([D.shares(counts[i], np.full(width, totals[i])) for i in range(rows)])
    r, c = np.nonzero(counts)
    tree = D.Quadtree(r, c, int(max(rows, width) - 1).bit_length())
    cells = whole[r, c][np.argsort(tree.cell_of(r, c))]
    left, right = np.triu_indices(rows, 1)
    got = D.differences(tree, D.shares(np.zeros(rows, np.int64), totals), cells, width, left, right)
    assert got.tolist() == [int(np.abs(whole[i] - whole[j]).sum()) for i, j in zip(left, right)]
    assert len(tree.cells) == len(r)
