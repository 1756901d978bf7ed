"""Packing of token pieces into sequences by bulk-synchronous best fit.

Pieces are range-sorted by length, longest first, and numbered within their length; gaps, the free ends of open
sequences, are kept sorted by size. A superstep takes the next length: its pieces sweep up the sorted gaps from
their successor, the smallest gap that holds them. The k-th piece in rank gets the k-th place, so no two pieces want
the same one; gaps shrink, and the next superstep begins. Pieces that no gap holds open sequences.

Equal lengths are interchangeable and so are equal gaps, so a superstep matches runs, "places 500 to 900 of length 17",
not rows. Runs are bounded by the sequence length (one new run and one split for each length), whatever the
number of documents. Rows meet their run by rank in the tasks that hold them.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import configure, per_batch, written
from fleetgauge.llm.tokens import default_vocabulary, token_ids

END_ID = 2
CAPACITY = 1024

PIECE_SCHEMA = "piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """``(start, ids)`` of the pieces: full ones, but for a first one that takes what is over."""
    over = len(ids) % capacity
    starts = ([0] if over else []) + list(range(over, len(ids), capacity))
    return [(s, ids[s : s + (over if s == 0 and over else capacity)]) for s in starts]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids and the end id."""

    def make():
        encoder = token_ids(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            owner: list[int] = []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encoder.encode(text or ""), np.uint32(END_ID)).astype("<u4", copy=False)
                for number, (start, part) in enumerate(cut(ids, capacity)):
                    rows.append((number, start, len(part), zlib.crc32(part)))
                    owner.append(at)
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    "piece": pa.array(columns[0], pa.int32()),
                    "start": pa.array(columns[1], pa.int64()),
                    "length": pa.array(columns[2], pa.int64()),
                    "ids_crc32": pa.array(columns[3], pa.int64()),
                }
            )

        return step

    kind = dict(docs.dtypes)["doc_id"]
    return per_batch(docs.select("doc_id", "text"), f"doc_id {kind}, {PIECE_SCHEMA}", make)


@dataclass(frozen=True)
class Run:
    """Pieces ``rank .. rank + count - 1`` of a length go to sequences from ``first``, ``per`` in each."""

    length: int
    rank: int
    count: int
    first: int
    per: int
    offset: int


def match_runs(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """The supersteps over ``counts`` of pieces by length: their runs, and the number of sequences.

    Places go to the smallest sufficient gap first, as best fit in descending order does piece by piece.
    """
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # by size: runs of sequences (first, count)
    sizes: list[int] = []  # of gaps, ascending
    sequences = 0

    def add_gap(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                size, per = capacity, capacity // length
                first, count = sequences, -(-left // per)
                sequences += count
            else:
                size = sizes[at]
                first, count = gaps[size].pop(0)
                if not gaps[size]:
                    del gaps[size], sizes[at]
                per = size // length
            used = min(count, -(-left // per))
            placed = min(left, used * per)
            runs.append(Run(length, rank, placed, first, per, capacity - size))
            add_gap(size, first + used, count - used)
            # the last sequence may hold fewer than the others
            full, rest = divmod(placed, per)
            add_gap(size - per * length, first, full)
            add_gap(size - rest * length, first + full, 1 if rest else 0)
            rank, left = rank + placed, left - placed
    return runs, sequences


def number_within_length(pieces: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 among pieces of equal length, by document and piece.

    Range sorting deals the rows out; a row's rank is its place in its own partition after what earlier
    partitions hold of its length. Only counts by partition and length are gathered, so a length that a third of all
    pieces have is spread over many tasks.
    """
    ranged = pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")

    def make():
        state = {"length": None, "place": 0}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            length = batch.column("length").to_numpy()
            fresh = np.flatnonzero(np.diff(length, prepend=length[0] - 1)) if len(length) else np.zeros(0, int)
            place = np.arange(len(length))
            place -= np.repeat(place[fresh], np.diff(np.append(fresh, len(length))))
            if len(length) and length[0] == state["length"]:
                place[: fresh[1] if len(fresh) > 1 else len(length)] += state["place"]
            if len(length):
                state.update(length=length[-1], place=place[-1] + 1)
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"]
            )

        return step

    ranged = ranged.withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"{n} {t}" for n, t in ranged.dtypes)
    return written(per_batch(ranged, f"{schema}, place bigint", make), "pieces")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: its place in sequences of at most ``capacity`` tokens.

    Columns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null or empty text is one piece with the
    end id alone. Rows with equal or null ids are packed each; which of two equal rows gets which place is then
    open. Other columns are ignored; an empty table gives no rows.
    """
    configure(docs.sparkSession)
    # written first: range sorting samples its input, and the texts are encoded only once
    pieces = written(token_pieces(docs, vocabulary or default_vocabulary(), capacity), "tokens")
    pieces = number_within_length(pieces)
    # at most one row for each length in a partition, summed up to one for each length
    held = pieces.groupBy("length", "part").count()
    held = written(held, "held")
    counts = {r["length"]: r["total"] for r in held.groupBy("length").agg(F.sum("count").alias("total")).collect()}
    runs, _ = match_runs(counts, capacity)

    # what earlier partitions hold of a length: few partitions share one, for they are ranges of lengths
    earlier = held.alias("a").join(held.alias("b"), "length", "left").where("b.part <= a.part")
    earlier = earlier.groupBy("length", F.col("a.part").alias("part")).agg(
        (F.sum("b.count") - F.max(F.when(F.expr("a.part = b.part"), F.col("b.count")))).alias("before")
    )
    ranked = pieces.join(earlier, ["length", "part"]).withColumn("rank", F.col("place") + F.col("before"))
    return _placed(ranked, runs)


def _placed(ranked: DataFrame, runs: list[Run]) -> DataFrame:
    """Gives each piece its sequence; the runs are bounded by the capacity, so each task holds them all."""
    order = sorted(runs, key=lambda r: (r.length, r.rank))
    values = np.array([[r.length, r.rank, r.count, r.first, r.per, r.offset] for r in order], np.int64).reshape(-1, 6)

    def make():
        lengths, ranks, _, firsts, pers, offsets = values.T
        begins = {int(n): int(i) for n, i in zip(*np.unique(lengths, return_index=True))}
        ends = {n: int(np.searchsorted(lengths, n, "right")) for n in begins}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                run[own] = begins[n] + np.searchsorted(ranks[begins[n] : ends[n]], rank[own], "right") - 1
            within = rank - ranks[run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            return pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names],
                    pa.array(firsts[run] + within // pers[run]),
                    pa.array(offsets[run] + within % pers[run] * length),
                ],
                names=[*names, "sequence_id", "offset"],
            )

        return step

    kind = dict(ranked.dtypes)["doc_id"]
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return per_batch(rows, f"doc_id {kind}, {PIECE_SCHEMA}, sequence_id bigint, offset bigint", make)
