"""Benchmark passages in training documents: BM25 over an inverted index with block-max WAND, then verification.

The test items are the index, the training passages are the queries. A document is cut into overlapping windows, each
long enough that any item that stands in the document stands whole in one of them. Index terms are pairs of adjacent
words: single ones are too common to tell anything. Impacts are BM25 weights divided by what the item scores against
itself, so one threshold serves short and long items alike, and WAND retrieves every item whose score reaches it.

A retrieved item is confirmed if the window holds enough of the five-word shingles of its question and of its answer:
the text up to its first question mark or line end, and what follows.

Documents never meet, so there is no shuffle. The index is built from the benchmark only, in parts of a fixed number of
items; each part is sent to the tasks and the documents are read once for each part, so a benchmark of any size needs no
more memory in a task.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.llm.shared import configure, per_batch

SHINGLE = 5
OVERLAP = 0.8
# Share of an item's own score that a passage must reach; confirmed passages lie far above.
RETRIEVE = 0.5
ITEMS_PER_PART = 20_000
BLOCK = 32
K1, B = 1.2, 0.75
_WORD = re.compile(r"\w+")
_QUESTION_END = re.compile(r"\?|\n")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words up to the first question mark or line end, and the words after it."""
    end = _QUESTION_END.search(text.strip())
    at = end.end() if end else len(text)
    stripped = text.strip()
    return words_of(stripped[:at]), words_of(stripped[at:])


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; fewer words are one shingle, none are none."""
    if not words:
        return set()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def overlap(part: list[str], window: list[str]) -> float:
    """Share of the part's shingles that the window holds; 1 for an empty part."""
    own = shingles(part)
    if not own:
        return 1.0
    size = min(SHINGLE, len(part))
    held = {tuple(window[i : i + size]) for i in range(len(window) - size + 1)}
    return len(own & held) / len(own)


@dataclass
class Postings:
    """Items of a term in ascending order with impacts, and the largest impact of each block."""

    items: np.ndarray
    impacts: np.ndarray
    block_last: np.ndarray
    block_max: np.ndarray
    largest: float


class Index:
    """BM25 index of items ``(id, text)``; an item of one word has that word as its only term."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        words = [words_of(t) for _, t in items]
        self.longest = max((len(w) for w in words), default=0)
        self.vocabulary: dict[str, int] = {}
        counts = []
        for own in words:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own]
            counts.append(Counter(zip(numbers, numbers[1:])) if len(own) > 1 else Counter({(n, -1): 1 for n in numbers}))
        frequency = Counter(t for c in counts for t in c)
        average = sum(c.total() for c in counts) / max(1, len(counts))
        postings: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for item, own in enumerate(counts):
            norm = K1 * (1 - B + B * own.total() / max(average, 1e-9))
            weights = {}
            for term, tf in own.items():
                idf = np.log(1 + (len(items) - frequency[term] + 0.5) / (frequency[term] + 0.5))
                weights[term] = idf * tf * (K1 + 1) / (tf + norm)
            total = sum(weights.values())
            for term, weight in weights.items():
                postings[term].append((item, weight / total))
        size = len(self.vocabulary) + 1
        ordered = sorted((a * size + b + 1, posting) for (a, b), posting in postings.items())
        self.codes = np.array([c for c, _ in ordered], np.int64)
        self.lists = [self._postings(p) for _, p in ordered]
        self.largest = np.array([p.largest for p in self.lists] + [0.0])

    @staticmethod
    def _postings(rows: list[tuple[int, float]]) -> Postings:
        items, impacts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        starts = np.arange(0, len(rows), BLOCK)
        last = items[np.minimum(starts + BLOCK, len(rows)) - 1]
        return Postings(items, impacts, last, np.maximum.reduceat(impacts, starts), float(impacts.max()))

    def terms(self, words: list[str]) -> np.ndarray:
        """Two rows: the list number of the word pair that begins at each word, and of the word alone; -1 without one."""
        get = self.vocabulary.get
        numbers = np.array([get(w, -1) for w in words], np.int64)
        size = len(self.vocabulary) + 1
        after = np.append(numbers[1:], -1)
        found = []
        for second in (np.where(after < 0, -2, after), np.full(len(numbers), -1)):
            code = np.where((numbers >= 0) & (second > -2), numbers * size + second + 1, -1)
            at = np.searchsorted(self.codes, code)
            hit = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == code)
            found.append(np.where(hit, at, -1))
        return np.array(found)

    def wand(self, lists: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every item whose summed impacts over the lists reach the threshold, with its score.

        Cursors are kept in item order. The pivot is the first cursor at which the largest impacts so far reach the
        threshold; items before it cannot. If the blocks around the pivot cannot either, all cursors skip past
        the nearest block end.
        """
        slack = threshold - 1e-12
        open_lists = [self.lists[i] for i in lists]
        cursors = [0] * len(open_lists)
        found = []
        while True:
            order = sorted(
                (i for i, p in enumerate(open_lists) if cursors[i] < len(p.items)),
                key=lambda i: open_lists[i].items[cursors[i]],
            )
            bound, pivot = 0.0, None
            for place, i in enumerate(order):
                bound += open_lists[i].largest
                if bound >= slack:
                    pivot = place
                    break
            if pivot is None:
                return found
            item = open_lists[order[pivot]].items[cursors[order[pivot]]]
            while pivot + 1 < len(order) and open_lists[order[pivot + 1]].items[cursors[order[pivot + 1]]] == item:
                pivot += 1
            ahead = order[: pivot + 1]
            blocks = [(open_lists[i], int(np.searchsorted(open_lists[i].block_last, item))) for i in ahead]
            if sum(p.block_max[b] for p, b in blocks if b < len(p.block_max)) < slack:
                ends = [p.block_last[b] + 1 for p, b in blocks if b < len(p.block_last)]
                after = order[pivot + 1 :]
                if after:
                    ends.append(open_lists[after[0]].items[cursors[after[0]]])
                target = max(min(ends), item + 1)
                for i in ahead:
                    cursors[i] = int(np.searchsorted(open_lists[i].items, target))
                continue
            score = 0.0
            for i in ahead:
                posting = open_lists[i]
                cursors[i] = int(np.searchsorted(posting.items, item))
                if cursors[i] < len(posting.items) and posting.items[cursors[i]] == item:
                    score += posting.impacts[cursors[i]]
                    cursors[i] += 1
            if score >= slack:
                found.append((int(item), float(score)))

    def search(self, text: str, retrieve: float, least: float) -> list[tuple[int, float, float, float]]:
        """``(item id, score, question overlap, answer overlap)`` of every item confirmed in the text, best window each."""
        words = words_of(text)
        if not words or not self.longest:
            return []
        terms = self.terms(words)
        if not (terms >= 0).any():
            return []
        bounds = np.concatenate([[0.0], np.cumsum(self.largest[terms].sum(axis=0))])
        step, best = self.longest, {}
        starts = np.arange(0, max(1, len(words) - step), step)
        ends = np.minimum(starts + 2 * step, len(words))
        # the sum of largest impacts bounds every score: below the threshold there is no pivot
        for at in np.flatnonzero(bounds[ends] - bounds[starts] >= retrieve - 1e-9):
            window = words[starts[at] : ends[at]]
            lists = np.unique(terms[:, starts[at] : ends[at]])
            for item, score in self.wand(lists[lists >= 0].tolist(), retrieve):
                question, answer = (overlap(part, window) for part in self.parts[item])
                if min(question, answer) >= least and score > best.get(item, (0.0,))[0]:
                    best[item] = (score, question, answer)
        return [(self.ids[item], *found) for item, found in sorted(best.items())]


def benchmark_parts(benchmark: DataFrame, per_part: int = ITEMS_PER_PART):
    """The items in parts of at most ``per_part``, read one part after another."""
    part: list[tuple[int, str]] = []
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if words_of(row["text"]):
            part.append((row["item_id"], row["text"]))
        if len(part) == per_part:
            yield part
            part = []
    if part:
        yield part


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, least: float = OVERLAP, per_part: int = ITEMS_PER_PART
) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every benchmark item found in a document.

    Whole texts are searched. Null and empty texts hold nothing; items without words are not looked for; equal items
    are one unless their ids differ. Repeated documents are searched each; other columns are ignored; an empty table on
    either side gives no rows. Items whose words stand apart in the document do not count, nor do items of which the
    question or the answer is missing.
    """
    spark = configure(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id bigint, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], schema)
    for items in benchmark_parts(benchmark, per_part):
        sent = spark.sparkContext.broadcast(items)  # at most per_part items

        def make(sent=sent):
            index = Index(sent.value)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                owner, rows = [], []
                for at, text in enumerate(batch.column("text").to_pylist()):
                    hits = index.search(text, retrieve, least) if text else []
                    owner += [at] * len(hits)
                    rows += hits
                columns = list(zip(*rows)) if rows else [[]] * 4
                return pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64())),
                        "item_id": pa.array(columns[0], pa.int64()),
                        "score": pa.array(columns[1], pa.float64()),
                        "question_overlap": pa.array(columns[2], pa.float64()),
                        "answer_overlap": pa.array(columns[3], pa.float64()),
                    }
                )

            return step

        found = found.union(per_batch(docs.select("doc_id", "text"), schema, make))
    return found
