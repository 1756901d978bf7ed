"""Token counts that follow edits: a segment tree per document over runs of pre-tokens.

The pre-tokenizer always cuts before a single space between two other characters, whatever stands further away. A
leaf is a run of pre-tokens between two such cuts; its characters and ids are summed up the tree. An edit finds its leaves by
descending along the character sums. They are encoded anew together with their neighbours wherever the edit
touches the three characters that make a cut, and the sums on the paths above them are updated. The rest of the text is not
looked at, and the total is exact: it is the number of ids of the whole edited text.

The tree is a few bytes beside its text and both travel in one row, so building and editing need no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import configure, per_batch
from fleetgauge.llm.tokens import TokenIds, default_vocabulary, token_ids

LEAF_CHARS = 256


def cut_points(text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Where leaves end: the first safe cut at least ``leaf_chars`` after the last one, and the end of the text."""
    cuts, at = [], leaf_chars
    while at < len(text) - 1:
        at = text.find(" ", at, len(text) - 1)
        if at < 0:
            break
        if at and not text[at - 1].isspace() and not text[at + 1].isspace():
            cuts.append(at)
            at += leaf_chars
        else:
            at += 1
    return [*cuts, len(text)]


def leaf_counts(text: str, encoder: TokenIds, leaf_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters and ids of each leaf of a text, which is encoded once."""
    ends = cut_points(text, leaf_chars)
    starts = [0, *ends[:-1]]
    byte_ends = np.cumsum([len(text[a:b].encode()) for a, b in zip(starts, ends)])
    id_ends = np.cumsum(encoder.token_bytes[encoder.encode(text)]) if text else np.zeros(0, np.int64)
    upto = np.searchsorted(id_ends, byte_ends, "right")
    return np.diff(ends, prepend=0), np.diff(upto, prepend=0)


class SegmentTree:
    """Sums of characters and ids over leaves; node 1 is the root, the children of ``i`` are ``2i`` and ``2i + 1``."""

    def __init__(self, chars: np.ndarray, ids: np.ndarray):
        self.leaves = 1 << max(0, int(len(chars) - 1).bit_length())
        self.sums = np.zeros((2 * self.leaves, 2), np.int64)
        self.sums[self.leaves : self.leaves + len(chars), 0] = chars
        self.sums[self.leaves : self.leaves + len(ids), 1] = ids
        for node in range(self.leaves - 1, 0, -1):
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def to_bytes(self) -> bytes:
        return self.sums.astype("<i4").tobytes() if self.sums[1, 0] < 2**31 else self.sums.astype("<i8").tobytes() + b"8"

    @classmethod
    def from_bytes(cls, data: bytes) -> SegmentTree:
        tree = cls.__new__(cls)
        kind, data = ("<i8", data[:-1]) if len(data) % 8 == 1 else ("<i4", data)
        tree.sums = np.frombuffer(data, kind).reshape(-1, 2).astype(np.int64)
        tree.leaves = len(tree.sums) // 2
        return tree

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, the last one with characters for the end, and where that leaf begins."""
        node, begin = 1, 0
        char = min(char, int(self.sums[1, 0]) - 1)
        while node < self.leaves:
            left = int(self.sums[2 * node, 0])
            if char - begin < left:
                node = 2 * node
            else:
                begin += left
                node = 2 * node + 1
        return node - self.leaves, begin

    def begin_of(self, leaf: int) -> int:
        """Characters before a leaf."""
        node, before = leaf + self.leaves, 0
        while node > 1:
            if node % 2:
                before += int(self.sums[node - 1, 0])
            node //= 2
        return before

    def set_leaves(self, first: int, chars: list[int], ids: list[int]) -> None:
        """Sets neighbouring leaves and updates the sums above them."""
        low, high = first + self.leaves, first + self.leaves + len(chars) - 1
        self.sums[low : high + 1, 0] = chars
        self.sums[low : high + 1, 1] = ids
        while low > 1:
            low, high = low // 2, high // 2
            for node in range(low, high + 1):
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]


def build_tree(text: str, encoder: TokenIds, leaf_chars: int = LEAF_CHARS) -> SegmentTree:
    return SegmentTree(*leaf_counts(text, encoder, leaf_chars))


def edit(
    text: str, tree: SegmentTree, start: int, stop: int, replacement: str, encoder: TokenIds, leaf_chars: int = LEAF_CHARS
) -> tuple[str, SegmentTree, int]:
    """The edited text, its tree, and how many characters were encoded for it.

    ``start`` and ``stop`` are code points of the current text, moved into it where they lie outside.
    """
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    after = text[:start] + replacement + text[stop:]
    if not text:
        return after, build_tree(after, encoder, leaf_chars), len(after)
    # a cut before character c rests on the characters c - 1, c and c + 1
    first, begin = tree.find(max(start - 2, 0))
    last, last_begin = tree.find(min(stop + 1, len(text) - 1))
    end = last_begin + int(tree.sums[tree.leaves + last, 0])
    region = after[begin : end + len(after) - len(text)]
    chars, ids = (list(map(int, c)) for c in leaf_counts(region, encoder, leaf_chars))
    room = last - first + 1
    if len(chars) > 2 * room:
        # much was inserted: the tree grows around the new leaves, nothing else is encoded
        old = tree.sums[tree.leaves :]
        parts = (old[:first], np.array([chars, ids]).T, old[last + 1 :])
        leaves = np.concatenate(parts)
        leaves = leaves[leaves[:, 0] > 0]
        return after, SegmentTree(leaves[:, 0], leaves[:, 1]), len(region)
    if len(chars) > room:
        chars, ids = chars[: room - 1] + [sum(chars[room - 1 :])], ids[: room - 1] + [sum(ids[room - 1 :])]
    empty = [0] * (room - len(chars))
    tree.set_leaves(first, chars + empty, ids + empty)
    return after, tree, len(region)


def with_trees(docs: DataFrame, vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Adds ``n_tokens`` and ``tree`` to every row of ``docs(doc_id, text)``; other columns are left out.

    A null or empty text has no tokens; a null one has no tree. Whole texts are encoded. Repeated rows are counted each;
    an empty table gives no rows.
    """
    configure(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def make():
        encoder = token_ids(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            trees = [None if t is None else build_tree(t, encoder, leaf_chars) for t in batch.column("text").to_pylist()]
            return pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "text": batch.column("text"),
                    "n_tokens": pa.array([t.total if t else 0 for t in trees], pa.int64()),
                    "tree": pa.array([t.to_bytes() if t else None for t in trees], pa.binary()),
                }
            )

        return step

    kind = dict(docs.dtypes)["doc_id"]
    return per_batch(docs.select("doc_id", "text"), f"doc_id {kind}, text string, n_tokens bigint, tree binary", make)


def gather_edits(edits: DataFrame) -> DataFrame:
    """``doc_id, edits``: the rows of ``edits(doc_id, seq, start, stop, replacement)`` of each document in order of ``seq``.

    Edits of a document build on one another, so they meet in one row.
    """
    row = F.struct("seq", "start", "stop", F.coalesce("replacement", F.lit("")).alias("replacement"))
    gathered = edits.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return gathered.select("doc_id", F.expr("transform(rows, r -> struct(r.start, r.stop, r.replacement))").alias("edits"))


def apply_edits(rows: DataFrame, vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Applies ``edits array<struct<start, stop, replacement>>`` to rows with ``doc_id, text, n_tokens, tree``.

    Returns ``doc_id, text, tree, n_before, n_tokens, n_encoded``: counts before and after, and the characters encoded.
    Each edit refers to the text as the ones before it left it; places outside the text are moved into it, a null
    place counts as 0, a null replacement as none. Null texts stay null and take no edits; a null list is empty.
    """
    configure(rows.sparkSession)
    path = vocabulary or default_vocabulary()

    def make():
        encoder = token_ids(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, trees, counts, encoded = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("text", "tree", "edits"))
            for text, data, edits in zip(*columns):
                tree, work = SegmentTree.from_bytes(data) if data is not None else None, 0
                for e in edits or [] if tree is not None else []:
                    text, tree, n = edit(
                        text, tree, e["start"] or 0, e["stop"] or 0, e["replacement"] or "", encoder, leaf_chars
                    )
                    work += n
                texts.append(text)
                trees.append(None if tree is None else tree.to_bytes())
                counts.append(0 if tree is None else tree.total)
                encoded.append(work)
            return pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "text": pa.array(texts, pa.string()),
                    "tree": pa.array(trees, pa.binary()),
                    "n_before": batch.column("n_tokens"),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "n_encoded": pa.array(encoded, pa.int64()),
                }
            )

        return step

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text string, tree binary, n_before bigint, n_tokens bigint, n_encoded bigint"
    return per_batch(rows.select("doc_id", "text", "n_tokens", "tree", "edits"), schema, make)
