"""Removal of text that repeats across documents, by hashing lines and the pieces of their words.

Units are normalised (letter case, white space) and hashed; digests are grouped over all documents, and the earliest
occurrence, by document id and place, is kept. Of the others go

* lines of at least ``min_line_words`` words that occur before, and
* runs of pieces that occur before, if a run has at least ``min_run_words`` words: a passage set into other text.

Pieces cut the whole text, across lines, after marks, and between marks before the words whose hash (with the word before)
is the smallest of some ``WINDOW`` neighbours. Cuts depend on nothing further away than a window: of 50 words that two texts
share, at most 15 at each end lie outside equal pieces, with marks and without. Where scripts have no blanks, each code
point is read as a word and counts for half of one.

Short lines and lone pieces stay, they repeat by chance. What is left keeps its order, and removed spans are reported in
offsets of the original text.

Units travel as a hash and a place. First places are combined before the shuffle. A digest that holds a thousandth of
all repeated units or more, of which there are a thousand at most, is broadcast; its units are dealt by place instead.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import configure, per_batch, written

MIN_LINE_WORDS = 8
MIN_RUN_WORDS = 20
# Neighbouring words of which the smallest hash makes a cut.
WINDOW = 8
# A digest with this share of all repeated units is hot; there are at most as many as shares.
HOT_SHARES = 1000
_MARKS = frozenset(".!?,;:。，！？；：、")
# Scripts written without blanks: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")
_NO_BLANKS = re.compile(f"[{_UNSPACED}]")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_KNOWN_WORDS = 1 << 17


class _WordHashes(dict):
    """Hashes of words, of which some are kept; the lowest bit says that a mark ends the word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word) & ~1 | (word[-1] in _MARKS)
        return found


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of unsigned 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_to(1 << max(12, n.bit_length())) if n < 1 << 16 else _powers_to.__wrapped__(n)


@lru_cache
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base of polynomial hashes, and of its inverse."""
    out = [np.full(n + 1, x, np.uint64) for x in (_BASE, _INVERSE)]
    for x in out:
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return out[0], out[1]


class Units:
    """The units of a text: ``n_lines`` lines with a word, then its pieces, each a range of words.

    ``begins, stops`` are the ranges, ``halves`` their length in half words and ``digests`` their hashes; a line and a piece
    of the same words have different ones.
    """

    def __init__(self, text: str) -> None:
        low = text.lower()
        mixed = not low.isascii() and _NO_BLANKS.search(low) is not None
        if mixed:
            low = _NO_BLANKS.sub(r" \g<0> ", low)
        words: list[str] = []
        edges = [0]
        for line in low.split("\n"):
            words += line.split()
            edges.append(len(words))
        n = self.n_words = len(words)
        hashes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
        sizes = np.full(n, 2)
        if mixed:
            sizes[[i for i, w in enumerate(words) if len(w) == 1 and _NO_BLANKS.match(w)]] = 1
        self.weights = np.append(0, np.cumsum(sizes))
        ends = np.array(edges)
        self.lines = np.flatnonzero(ends[1:] > ends[:-1])
        self.n_lines = len(self.lines)
        cuts = np.concatenate(([0], _cuts(hashes), [n])) if n else np.zeros(1, np.int64)
        self.begins = np.append(ends[self.lines], cuts[:-1])
        self.stops = np.append(ends[self.lines + 1], cuts[1:])
        self.halves = self.weights[self.stops] - self.weights[self.begins]
        self._word_hashes = hashes

    @cached_property
    def digests(self) -> np.ndarray:
        """Polynomial hashes of the ranges, from running sums."""
        hashes = self._word_hashes
        n = len(hashes)
        powers, back = _powers(n)
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(_mixed(hashes) * powers[:n], dtype=np.uint64))
        values = (sums[self.stops] - sums[self.begins]) * back[self.begins]
        length = (self.stops - self.begins).astype(np.uint64)
        kind = (np.arange(len(values)) < self.n_lines).astype(np.uint64)
        return _mixed(_mixed(values + length) + kind).view(np.int64)


def _cuts(hashes: np.ndarray) -> np.ndarray:
    """Where pieces begin, apart from the first: behind marks, and at the smallest places of each window without any."""
    if len(hashes) < 2:
        return np.zeros(0, np.int64)
    forced = (hashes[:-1] & np.uint64(1)).astype(bool)
    cut = forced.copy()
    if len(forced) >= WINDOW:
        pairs = _mixed(hashes[1:] ^ _mixed(hashes[:-1])) | np.uint64(1)
        pairs[forced] = 0
        lowest = _sliding(np.minimum, pairs)
        # a place is smallest in a window if the greatest minimum of its windows is its own; a mark makes a window's zero
        edge = np.zeros(WINDOW - 1, np.uint64)
        cut |= _sliding(np.maximum, np.concatenate((edge, lowest, edge))) == pairs
    return np.flatnonzero(cut) + 1


def _sliding(best: np.ufunc, x: np.ndarray) -> np.ndarray:
    """The best of each ``WINDOW`` neighbours, a power of two, by doubling."""
    size = 1
    while size < WINDOW:
        x = best(x[:-size], x[size:])
        size *= 2
    return x


def unit_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, place, digest`` of every unit of ``docs(doc_id, text)``."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [Units(text).digests if text else np.zeros(0, np.int64) for text in batch.column("text").to_pylist()]
            sizes = [len(f) for f in found]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes] or [np.zeros(0, np.int32)])
            return pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    "place": pa.array(place, pa.int32()),
                    "digest": pa.array(np.concatenate(found or [np.zeros(0, np.int64)]), pa.int64()),
                }
            )

        return step

    return per_batch(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, place int, digest bigint", make)


def repeated_units(rows: DataFrame) -> DataFrame:
    """``doc_id, place`` of the units whose digest occurs at an earlier document or place.

    Units of hot digests, which meet their first place by broadcast, take a key of their own in the shuffle.
    """
    first = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n"))
    first = written(first.filter("n > 1"), "first")
    total = first.agg(F.sum("n")).first()[0] or 0
    # each holds a share of the total, so there are no more rows than shares
    hot = first.filter(F.col("n") * HOT_SHARES >= total).select("digest", F.col("first").alias("hot_first"))
    cold = first.filter(F.col("n") * HOT_SHARES < total).select(F.col("digest").alias("key"), "first")
    keyed = rows.join(F.broadcast(hot), "digest", "left").filter("hot_first IS NULL OR struct(doc_id, place) > hot_first")
    keyed = keyed.withColumn("key", F.expr("IF(hot_first IS NULL, digest, xxhash64(doc_id, place))"))
    both = keyed.join(cold, "key", "left").filter("hot_first IS NOT NULL OR struct(doc_id, place) > first")
    return both.select("doc_id", "place")


def removed_spans(text: str, places: set[int], min_line_words: int, min_run_words: int) -> list[tuple[int, int]]:
    """Spans to remove from a text, given the places of its repeated units; sorted, none touching another."""
    units = Units(text)
    again = np.zeros(len(units.begins), bool)
    again[list(places)] = True
    long_lines = np.flatnonzero(again[: units.n_lines] & (units.halves[: units.n_lines] >= 2 * min_line_words))
    inner = np.append(False, np.append(again[units.n_lines :], False))
    change = np.flatnonzero(inner[1:] != inner[:-1]) + units.n_lines
    runs = [(units.begins[a], units.stops[b - 1]) for a, b in zip(change[::2], change[1::2])]
    runs = [(a, b) for a, b in runs if units.weights[b] - units.weights[a] >= 2 * min_run_words]
    spans: list[tuple[int, int]] = []
    if len(long_lines):
        ends = np.cumsum([len(line) + 1 for line in text.split("\n")]) - 1
        spans += [(int(ends[i - 1]) + 1 if i else 0, int(ends[i])) for i in units.lines[long_lines]]
    if runs:
        found = [m.span() for m in _WORD.finditer(text)]
        for begin, stop in runs:
            # up to the next word, so that no blanks are left double; but not over a line's end
            last = found[stop - 1][1]
            next_word = found[stop][0] if stop < len(found) else len(text)
            line_end = text.find("\n", last, next_word)
            spans.append((found[begin][0], next_word if line_end < 0 else line_end))
    merged: list[tuple[int, int]] = []
    for begin, stop in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((begin, stop))
    return merged


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a line that is removed whole goes with its line end."""
    kept, at = [], 0
    for begin, stop in spans:
        whole = (begin == 0 or text[begin - 1] == "\n") and (stop == len(text) or text[stop] == "\n")
        kept.append(text[at:begin])
        at = stop + 1 if whole and stop < len(text) else stop
    kept.append(text[at:])
    return "".join(kept)


def remove_repeats(
    docs: DataFrame, min_line_words: int = MIN_LINE_WORDS, min_run_words: int = MIN_RUN_WORDS
) -> DataFrame:
    """``doc_id, text, n_removed, spans`` of every row of ``docs(doc_id, text)``.

    ``spans`` lists what was removed as ``begin:stop`` in code points of the original, comma-joined; empty if nothing
    was. Ids may be of any type with an order. Null texts stay null, empty ones empty. Rows with one id count as one document, so equal rows lose the same;
    rows with a null id neither lose nor cause a loss. Ties in rank cannot occur otherwise: a place is one unit. Other
    columns are ignored; an empty table gives no rows.
    """
    configure(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    # read twice; they take less time to write and read than to make again
    again = repeated_units(written(unit_rows(docs.filter("doc_id IS NOT NULL")), "units"))
    # documents meet here with their own places only, groups of copies never do
    places = written(again.groupBy("doc_id").agg(F.collect_set("place").alias("places")), "repeated")
    both = docs.join(places, "doc_id", "left")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, spans = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                own = removed_spans(text, set(found), min_line_words, min_run_words) if text and found else []
                texts.append(without_spans(text, own) if own else text)
                spans.append(own)
            return pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "text": pa.array(texts, pa.string()),
                    "n_removed": pa.array([len(s) for s in spans], pa.int64()),
                    "spans": pa.array([",".join(f"{b}:{e}" for b, e in s) for s in spans], pa.string()),
                }
            )

        return step

    kind = dict(docs.dtypes)["doc_id"]
    return per_batch(both, f"doc_id {kind}, text string, n_removed bigint, spans string", make)
