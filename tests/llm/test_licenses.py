import random
import re

import pytest

from fleetgauge.llm import license_scan as L
from fleetgauge.llm.license_templates import PHRASES, TEMPLATES, Template
from fleetgauge.llm.shared import word_chunks

FIELDS = "doc_id long, text string"


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_base(text):
    words = plain_words(text)
    places = [
        (i, p.label) for p in PHRASES for i in range(len(words)) if words[i : i + len(p.text.split())] == p.text.split()
    ]
    first, last = min((i for i, _ in places), default=None), max((i for i, _ in places), default=None)
    return len(words), len(places), first, last, ",".join(sorted({label for _, label in places}))


def plain_matches(words, templates, least):
    """Runs of words that stand in a template and can be extended neither way, at every place of it, by comparing all."""
    where = {}
    for t, template in enumerate(templates):
        for i in range(len(template)):
            for j in range(i + least, len(template) + 1):
                where.setdefault(tuple(template[i:j]), set()).add((t, i))
    runs = {(i, j) for i in range(len(words)) for j in range(i + least, len(words) + 1) if tuple(words[i:j]) in where}
    longest = [(i, j) for i, j in runs if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in runs)]
    return {(t, i, place, j - i) for i, j in longest for t, place in where[tuple(words[i:j])]}


@pytest.mark.parametrize("seed", range(40))
def test_matches_agree_with_comparing_all(seed):
    draw = random.Random(seed)
    letters = "abcde"[: draw.randrange(1, 6)]
    templates = [Template(str(i), " ".join(draw.choices(letters, k=draw.randrange(1, 15)))) for i in range(4)]
    phrases = [Template("p", " ".join(draw.choices(letters, k=draw.randrange(1, 4)))) for _ in range(2)]
    known = L.Automaton(templates, phrases)
    text = " ".join(draw.choices([*letters, "z"], k=draw.randrange(0, 30)))
    least = draw.randrange(1, 4)
    n_words, named, runs = known.walk(word_chunks(text, L.WORD, 3), least)
    got = {(t, *m) for t, ms in known.matches(runs).items() for m in ms}
    words = text.split()
    assert n_words == len(words)
    both = [p.text.split() for p in (*templates, *phrases)]
    assert got == {m for m in plain_matches(words, both, least) if m[0] < len(templates)}
    assert sorted(named) == sorted(
        (k, i) for k, p in enumerate(phrases) for i in range(len(words)) if words[i : i + len(p.text.split())] == p.text.split()
    )


@pytest.mark.parametrize("seed", range(20))
def test_best_chain_agrees_with_trying_all(seed):
    draw = random.Random(seed)
    matches, at = [], 0
    for _ in range(draw.randrange(1, 8)):
        at += draw.randrange(1, 6)
        matches.append(L.Match(at, draw.randrange(0, 12), draw.randrange(2, 5)))
    matches = [m for i, m in enumerate(matches) if all(p.at + p.length <= m.at + m.length for p in matches[:i])]
    gap = 4

    def best_from(i, covered):
        found = covered
        for j in range(i + 1, len(matches)):
            a, b = matches[i], matches[j]
            shared = max(0, a.at + a.length - b.at, a.place + a.length - b.place)
            if a.at < b.at and a.place < b.place and shared < b.length and b.at - a.at - a.length <= gap:
                found = max(found, best_from(j, covered + b.length - shared))
        return found

    chained = list(L.chains(matches, gap))
    assert chained[0][2] == max(best_from(i, m.length) for i, m in enumerate(matches))
    assert sum(1 for _ in chained) <= len(matches)


def test_base_columns_agree_with_plain_search(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    odd = [None, "", "\n \t", "MIT LICENSE", "mit  -- license mit license", "smit license", "général public license", "É" * 70_000,
           "x" * 1_500_000 + " Apache License", "general public license " * 60_000, "mit\x00license MIT_License"]
    rows = [(r.doc_id, r.text) for r in given] + [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "mit license")]
    found = L.scan_licenses(spark.createDataFrame([(*r, 1, "x") for r in rows], f"{FIELDS}, n_words int, spans string"))
    assert found.columns == [
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans",
    ]
    got = {r.doc_id: r for r in found.collect()}
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: plain_base(t) for i, t in rows}
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in got.values())
    assert got[10_003].labels == "mit" and got[10_003].score == 1.0 and got[10_000].score == 0.0


def test_quoted_licences_earn_their_label(spark):
    mit, bsd3 = TEMPLATES[0].text, TEMPLATES[2].text
    texts = {
        1: "Some code.\n" + mit.replace("free of charge", "for nothing at all").replace("merge, ", "") + "\nThe end.",
        2: " ".join(mit.split()[:60]),  # part of a notice is none
        3: f"{bsd3}\n\n{mit}",
        4: "Licensed under CC BY-NC 4.0.",
        5: "We met under the same terms as the general public, without any licence.",
        6: f"{bsd3} {bsd3}",
        7: mit[: len(mit) // 2] + " other" * 500 + mit[len(mit) // 2 :],  # halves too far apart
    }
    found = L.scan_licenses(spark.createDataFrame(list(texts.items()), FIELDS)).collect()
    got = {r.doc_id: r for r in found}
    assert {i: r.labels for i, r in got.items()} == {
        1: "mit", 2: "", 3: "bsd-3-clause,mit", 4: "cc-by-nc", 5: "", 6: "bsd-3-clause", 7: "",
    }
    assert 0.9 < got[1].score < 1 and got[3].score == 1.0 and len(got[6].spans) == 2
    span = got[4].spans[0]
    assert (span.label, span.start_word, span.stop_word, span.share) == ("cc-by-nc", 0, 7, 1.0)


def test_empty_table_other_templates_and_limits(spark, empty):
    assert L.scan_licenses(empty(FIELDS)).collect() == []
    rows = spark.createDataFrame([("k", "our own terms apply here"), ("k", "our own terms apply here")], "doc_id string, text string")
    found = L.scan_licenses(rows, [Template("own", "Our own terms apply")], []).collect()
    assert [(r.doc_id, r.labels, r.n_base) for r in found] == [("k", "own", 0)] * 2
    with pytest.raises(ValueError):
        L.Automaton([Template("none", "...")], [])
