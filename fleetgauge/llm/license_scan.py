"""Licence notices in documents: matching statistics on a generalised suffix automaton, chained into template spans.

The words of all templates stand in one automaton, parted by marks no document has. A document streams through it
word by word; the state and length after each word are the longest run of words that ends there and stands in some
template. A run that cannot be extended to the right is a match, at every place of a template it stands at. Matches of a
template that follow each other in the document and in the template are chained by the number of template words they
cover, and a chain is a span: of a template, from one word of the document to another, with the covered share.

Phrases are found on the same walk: a state knows the phrases that every run it stands for ends with.

Time grows in proportion to the words of a document, times the length of the longest template where matches overlap;
memory with its matches. The automaton has at most twice the templates' words, which ``MAX_TEMPLATE_WORDS`` bounds; it is
built once in each worker. Documents do not meet: no shuffle, and no document is cut.

A null text has no words: counts 0, null places, no labels, score 0, and so has an empty one. Repeated rows are scanned
each on its own, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import chain as concat
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.llm.license_templates import PHRASES, TEMPLATES, Template
from fleetgauge.llm.shared import per_batch, word_chunks

# Lower-case letters, digits and whatever lies beyond ASCII.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_MATCH_WORDS = 3
MAX_GAP_WORDS = 20
MIN_SHARE = 0.8
MAX_TEMPLATE_WORDS = 1_000_000


class Match(NamedTuple):
    """Words of the document from ``at`` that stand in a template from ``place``."""

    at: int
    place: int
    length: int


class Span(NamedTuple):
    template: int
    start: int
    stop: int
    covered: int


def words_of(text: str) -> list[bytes]:
    return list(concat.from_iterable(word_chunks(text, WORD)))


class Automaton:
    """Suffix automaton of all templates and phrases; ``ends`` lists where a state's runs end, as one range per state."""

    def __init__(self, templates: Sequence[Template], phrases: Sequence[Template]):
        texts = [words_of(t.text) for t in (*templates, *phrases)]
        if sum(map(len, texts)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        if not all(texts):
            raise ValueError("a template without words")
        self.sizes = [len(t) for t in texts[: len(templates)]]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, own = [-1], [0], [-1]
        self.starts: list[int] = []
        last, position = 0, 0
        for number, words in enumerate(texts):
            self.starts.append(position)
            for word in words:
                symbol = self.vocabulary.setdefault(word, len(self.vocabulary))
                last = self._extend(last, symbol, own, position)
                position += 1
            last = self._extend(last, -1 - number, own, position)
            position += 1
        self._order(own)
        self._mark(phrases, texts[len(templates) :], self.starts[len(templates)] if phrases else position)

    def _extend(self, last: int, symbol: int, own: list[int], position: int) -> int:
        def add(length: int, link: int, moves: dict[int, int], end: int) -> int:
            self.length.append(length)
            self.link.append(link)
            self.next.append(moves)
            own.append(end)
            return len(own) - 1

        new = add(self.length[last] + 1, 0, {}, position)
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            if self.length[target] > self.length[state] + 1:
                split = add(self.length[state] + 1, self.link[target], dict(self.next[target]), -1)
                while state >= 0 and self.next[state].get(symbol) == target:
                    self.next[state][symbol] = split
                    state = self.link[state]
                self.link[target] = split
                target = split
            self.link[new] = target
        return new

    def _order(self, own: list[int]) -> None:
        """Lists end positions so that those below a state in the tree of links are one range."""
        below: list[list[int]] = [[] for _ in own]
        for state in range(1, len(own)):
            below[self.link[state]].append(state)
        self.ends: list[int] = []
        self.range: list[tuple[int, int]] = [(0, 0)] * len(own)
        stack = [(0, -1)]
        while stack:
            state, begun = stack.pop()
            if begun >= 0:
                self.range[state] = (begun, len(self.ends))
                continue
            stack.append((state, len(self.ends)))
            if own[state] >= 0:
                self.ends.append(own[state])
            stack += [(child, -1) for child in below[state]]
        self.below = below

    def _mark(self, phrases: Sequence[Template], texts: list[list[bytes]], bound: int) -> None:
        """Which phrases a state's runs end with, and where the templates end and the phrases begin."""
        self.bound = bound
        self.found: list[tuple[int, ...]] = [()] * len(self.next)
        for number, words in enumerate(texts):
            state = 0
            for word in words:
                state = self.next[state][self.vocabulary[word]]
            # A run that ends like this phrase is a run of this state, at least as long as the phrase, or of one below it.
            stack = [state]
            while stack:
                state = stack.pop()
                self.found[state] += (number,)
                stack += self.below[state]
        self.phrase_sizes = [len(words) for words in texts]

    def walk(self, chunks: Iterable[list[bytes]], least: int) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Number of words, ``(phrase, start)`` of all phrases, ``(end, length, state)`` of runs of ``least`` words or more."""
        look, moves, link, longest, found, sizes = (
            self.vocabulary.get, self.next, self.link, self.length, self.found, self.phrase_sizes,
        )
        phrases: list[tuple[int, int]] = []
        runs: list[tuple[int, int, int]] = []
        state = length = 0
        at = -1
        for words in chunks:
            for at, symbol in enumerate(map(look, words), at + 1):
                after = None if symbol is None else moves[state].get(symbol)
                if after is not None:
                    state = after
                    length += 1
                elif state:
                    if length >= least:
                        runs.append((at, length, state))
                    if symbol is None:
                        state = length = 0
                        continue
                    while state > 0 and symbol not in moves[state]:
                        state = link[state]
                    length = longest[state]
                    state = moves[state].get(symbol, 0)
                    length = length + 1 if state else 0
                else:
                    continue
                for number in found[state]:
                    if length >= sizes[number]:
                        phrases.append((number, at - sizes[number] + 1))
        if length >= least:
            runs.append((at + 1, length, state))
        return at + 1, phrases, runs

    def matches(self, runs: list[tuple[int, int, int]]) -> dict[int, list[Match]]:
        """The runs at every place of a template, by template, in order of the document."""
        placed: dict[int, list[Match]] = {}
        for end, length, state in runs:
            low, high = self.range[state]
            for stop in sorted(self.ends[low:high]):
                if stop < self.bound:
                    template = bisect_right(self.starts, stop) - 1
                    place = stop + 1 - length - self.starts[template]
                    placed.setdefault(template, []).append(Match(end - length, place, length))
        return placed


def chains(matches: list[Match], max_gap: int) -> Iterable[tuple[int, int, int]]:
    """``(start, stop, covered)`` of the matches of one template, in order of the document, chained.

    A match may follow one that starts before it in the document and in the template and ends at most ``max_gap`` words
    before it; words that both cover count once. Chains are given out from the best down, each match in one of them.
    """
    best = [m.length for m in matches]
    before = [-1] * len(matches)
    first = 0
    for i, m in enumerate(matches):
        while matches[first].at + matches[first].length + max_gap < m.at:
            first += 1
        for j in range(first, i):
            p = matches[j]
            shared = max(0, p.at + p.length - m.at, p.place + p.length - m.place)
            if p.at < m.at and p.place < m.place and shared < m.length and m.at - p.at - p.length <= max_gap:
                if best[j] + m.length - shared > best[i]:
                    best[i], before[i] = best[j] + m.length - shared, j
    used = [False] * len(matches)
    for i in sorted(range(len(matches)), key=lambda i: (-best[i], i)):
        if used[i]:
            continue
        last, stop = i, matches[i].at + matches[i].length
        used[i] = True
        while before[last] >= 0 and not used[before[last]]:
            last = before[last]
            used[last] = True
        covered = best[i] - best[last] + matches[last].length
        yield matches[last].at, stop, covered


@lru_cache(maxsize=2)
def automaton(templates: tuple[Template, ...], phrases: tuple[Template, ...]) -> Automaton:
    return Automaton(templates, phrases)


def scan(text: str, known: Automaton, least: int, max_gap: int) -> tuple[int, list[tuple[int, int]], list[Span]]:
    """Number of words, places of phrases, and spans of templates of one text, in order of the document."""
    n_words, phrases, runs = known.walk(word_chunks(text, WORD), least)
    spans = [
        Span(template, *chained)
        for template, matches in known.matches(runs).items()
        for chained in chains(matches, max_gap)
    ]
    return n_words, phrases, sorted(spans, key=lambda s: (s.start, s.stop, s.template))


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    phrases: Sequence[Template] = PHRASES,
    min_match_words: int = MIN_MATCH_WORDS,
    max_gap_words: int = MAX_GAP_WORDS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """The licences each of ``docs(doc_id, text)`` names or quotes.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the phrases; ``labels``: those of the phrases
    and of templates of which at least ``min_share`` is covered by one chain; ``score``: the largest covered share of any
    template, 1 where a phrase stands; ``spans``: every chain that earns its label.
    """
    templates, phrases = tuple(templates), tuple(phrases)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        known = automaton(templates, phrases)

        def row(text: str | None) -> dict:
            n_words, base, spans = scan(text or "", known, min_match_words, max_gap_words)
            shares = [s.covered / known.sizes[s.template] for s in spans]
            wide = [(s, share) for s, share in zip(spans, shares) if share >= min_share]
            named = {phrases[number].label for number, _ in base}
            return {
                "n_words": n_words,
                "n_base": len(base),
                "first_word": min((at for _, at in base), default=None),
                "last_word": max((at for _, at in base), default=None),
                "base_labels": ",".join(sorted(named)),
                "labels": ",".join(sorted(named | {templates[s.template].label for s, _ in wide})),
                "score": 1.0 if base else max(shares, default=0.0),
                "spans": [
                    {"label": templates[s.template].label, "start_word": s.start, "stop_word": s.stop, "share": share}
                    for s, share in wide
                ],
            }

        fields = pa.schema(
            [(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")]
            + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
            + [("spans", pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("stop_word", pa.int64()), ("share", pa.float64())])))]
        )

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.RecordBatch.from_pylist([row(text.as_py()) for text in batch.column("text")], schema=fields)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.columns], ["doc_id", *fields.names])

        return step

    schema = (
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<label:string,start_word:bigint,stop_word:bigint,share:double>>"
    )
    return per_batch(docs.select("doc_id", "text"), schema, make)
