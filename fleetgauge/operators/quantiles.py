"""Exact quantiles per stage by radix selection: one route for every stage, whether it has three tasks or billions.

The first read of the tasks gathers each stage's values, a bounded number for each measure: as they are while they are no more than
there can be value ranges, and counted by digit from there on, with the smallest and largest value of each range. They are gathered in the
tasks that read them first, so a hot stage costs one row per map task, and put together after one shuffle of these rows. Running counts tell which
value or range holds each wanted rank. A rank at either end of its range, or in a range of equal values, is known at once. The second
read narrows the rest: only values in the ranges still open are counted one by one, again map-side, and ordered within their range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.text import array_of
from fleetgauge.schemas import QUANTILE_SLOTS

QUARTERS = len(QUANTILE_SLOTS) - 1
# Digits per power of two: at most 64 * 2 * DIGITS ranges for all values, one for each value up to about DIGITS.
DIGITS = 128
POWERS = 2 * 64


def quantile_struct(slots: str) -> str:
    """Five-slot array as a struct of doubles."""
    fields = ", ".join(f"'{name}', double({slots}[{i}])" for i, name in enumerate(QUANTILE_SLOTS))
    return f"named_struct({fields})"


def zero_quantiles() -> str:
    return f"named_struct({', '.join(f"'{name}', 0.0D" for name in QUANTILE_SLOTS)})"


def digit(v: np.ndarray, digits: int) -> np.ndarray:
    """Which value range each of ``v`` falls in, ``digits`` for each power of two; grows with the value. Exact, so the same everywhere."""
    part, power = np.frexp(1.0 + np.abs(v.astype(np.float64)))
    place = power.astype(np.int64) * digits + np.floor((2 * part - 1) * digits).astype(np.int64)
    return np.where(v < 0, -place, place)


@dataclass
class Ranges:
    """Value ranges of some stages: ``group`` is stage number * measures + measure; a single value is a range with ``lo = hi``."""

    group: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray

    def take(self, rows: np.ndarray) -> Ranges:
        return Ranges(self.group[rows], self.lo[rows], self.hi[rows], self.n[rows])

    def ordered(self, digits: int) -> Ranges:
        """Ordered by group and value; a group of more than ``POWERS * digits`` rows, or one that was counted by digit, is so again."""
        # ranges of one digit, counted apart, may overlap, but begin in the digit's order
        found = self.take(np.lexsort((self.lo, self.group)))
        counts = np.bincount(found.group)
        coarse = counts > POWERS * digits
        coarse[found.group[found.n > 1]] = True
        chosen = coarse[found.group]
        if not chosen.any():
            return found
        key = np.where(chosen, digit(found.lo, digits), np.arange(len(chosen)))
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (found.group[1:] != found.group[:-1])])
        return Ranges(
            found.group[starts], found.lo[starts], np.maximum.reduceat(found.hi, starts), np.add.reduceat(found.n, starts)
        )

    @staticmethod
    def concat(parts: list[Ranges]) -> Ranges:
        return Ranges(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("group", "lo", "hi", "n")))


def of_tasks(batch: pa.RecordBatch, keys: int, stage: np.ndarray) -> Ranges:
    """Every value of the measures that follow the keys, for itself; nulls do not count."""
    parts, width = [], batch.num_columns - keys
    for m in range(width):
        column = batch.column(keys + m)
        values = column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        parts.append(Ranges(stage[rows] * width + m, values, values, np.ones(len(values), np.int64)))
    return Ranges.concat(parts)


def of_lists(batch: pa.RecordBatch, keys: int, stage: np.ndarray, width: int) -> Ranges:
    """Ranges gathered before; ``hi`` and ``n`` are left out where all are single values."""
    sizes, lo, hi, n = (batch.column(keys + i) for i in range(4))
    counts = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.repeat(np.repeat(stage, width) * width + np.tile(np.arange(width), len(stage)), counts)
    low = lo.flatten().to_numpy(zero_copy_only=False)
    high, times = low.copy(), np.ones(len(low), np.int64)
    counted = np.repeat(pc.list_value_length(n).to_numpy(zero_copy_only=False) > 0, counts.reshape(-1, width).sum(axis=1))
    high[counted] = hi.flatten().to_numpy(zero_copy_only=False)
    times[counted] = n.flatten().to_numpy(zero_copy_only=False)
    return Ranges(group, low, high, times)


def whole_stages(batches: Iterator[pa.RecordBatch], keys: int, width: int, digits: int, packed: bool) -> Iterator[tuple[list, Ranges]]:
    """Keys of stages, and their ordered ranges; the rows of a stage follow each other, also across batches."""
    head, held = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(i) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for column in columns:
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        first = [column[0].as_py() for column in columns]
        # the stage held back is number 0; it goes on, or the batch begins with number 1
        new[0] = head is not None and first != head
        stage = np.cumsum(new)
        found = of_lists(batch, keys, stage, width) if packed else of_tasks(batch, keys, stage)
        if held is not None:
            found = Ranges.concat([held, found])
        found = found.ordered(digits) if len(found.lo) else found
        starts = np.flatnonzero(new)
        names = [pa.concat_arrays([pa.array([value], column.type), column.take(pa.array(starts))]) for value, column in
                 zip(first if head is None else head, columns)]
        last = stage[-1]
        open_ones = found.group >= last * width
        if last > 0:
            yield [name[:last] for name in names], found.take(~open_ones)
        held = found.take(open_ones)
        held.group = held.group - last * width
        head = [name[int(last)].as_py() for name in names]
    if head is not None:
        yield [pa.array([value], column.type) for value, column in zip(head, columns)], held


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def gathered(names: list, found: Ranges, width: int) -> pa.RecordBatch:
    """One row per stage: how many ranges each measure has, and the ranges of all in turn."""
    stages = len(names[0])
    counts = np.bincount(found.group, minlength=stages * width)
    whole = counts.reshape(-1, width).sum(axis=1)
    stage = found.group // width
    counted = np.zeros(stages, bool)
    counted[stage[found.n > 1]] = True
    kept, sizes = counted[stage], np.where(counted, whole, 0)
    columns = [lists(counts.astype(np.int32), np.full(stages, width)), lists(found.lo, whole), lists(found.hi[kept], sizes), lists(found.n[kept], sizes)]
    return pa.RecordBatch.from_arrays([*names, *columns], names=[*(f"k{i}" for i in range(len(names))), "sizes", "lo", "hi", "n"])


def ranked(names: list, found: Ranges, width: int) -> pa.RecordBatch:
    """One row per stage: how many values each measure has, the value at each wanted rank if it is known, and where the others are."""
    stages, places = len(names[0]), 2 * (QUARTERS + 1)
    last = np.cumsum(found.n)
    total = np.zeros(stages * width, np.int64)
    np.add.at(total, found.group, found.n)
    base = np.cumsum(total) - total
    share = (total[:, None] - 1) * np.arange(QUARTERS + 1)
    low = share // QUARTERS
    rank = np.stack([low, np.minimum(low + 1, total[:, None] - 1)], axis=2).reshape(-1, places)
    present = np.broadcast_to((total > 0)[:, None], rank.shape).ravel()
    target = (base[:, None] + rank).ravel()
    at_range = np.minimum(np.searchsorted(last, target, side="right"), len(last) - 1)
    lo, hi, n = found.lo[at_range], found.hi[at_range], found.n[at_range]
    at = target - (last[at_range] - n)
    known = present & ((at == 0) | (at == n - 1) | (lo == hi))
    value = np.where((at == 0) | (lo == hi), lo, hi)
    aims = present & ~known
    goal = np.tile(np.arange(width * places), stages)
    fields = {"goal": goal.astype(np.int32), "m": (goal // places).astype(np.int32), "lo": lo, "hi": hi, "at": at}
    aim = pa.StructArray.from_arrays([pa.array(v[aims]) for v in fields.values()], names=list(fields))
    offsets = np.r_[0, np.cumsum(aims.reshape(stages, -1).sum(axis=1))].astype(np.int32)
    value_lists = pa.ListArray.from_arrays(
        pa.array((np.arange(stages + 1) * width * places).astype(np.int32)), pa.array(value, pa.int64(), mask=~known)
    )
    columns = [lists(total, np.full(stages, width)), value_lists, pa.ListArray.from_arrays(pa.array(offsets), aim)]
    batch = pa.RecordBatch.from_arrays([*names, *columns], names=[*(f"k{i}" for i in range(len(names))), "totals", "known", "aims"])
    # a stage of nothing but nulls has no quantiles
    return batch.filter(pa.array(total.reshape(stages, width).any(axis=1)))


def rank_goals(tasks: DataFrame, keys: list[str], measures: dict[str, str], digits: int) -> DataFrame:
    """``goals`` per stage: ``totals`` of its values, ``known`` values at the wanted ranks, and ``aims``: the ranges that hold the other ranks."""
    present = " AND ".join(f"`{c}` IS NOT NULL" for c in keys)
    values = tasks.filter(present).selectExpr(*keys, *[f"bigint({column}) AS m{i}" for i, column in enumerate(measures.values())])
    width, count = len(measures), len(keys)
    key_types = ", ".join(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in keys)

    def named(batch):
        return pa.RecordBatch.from_arrays(batch.columns, names=[*keys, *batch.schema.names[count:]])

    def gather(batches):
        for names, found in whole_stages(batches, count, width, digits, packed=False):
            yield named(gathered(names, found, width))

    def rank(batches):
        for names, found in whole_stages(batches, count, width, digits, packed=True):
            if len(found.lo):
                yield named(ranked(names, found, width))

    ranges = values.sortWithinPartitions(*keys).mapInArrow(
        gather, f"{key_types}, sizes array<int>, lo array<bigint>, hi array<bigint>, n array<bigint>"
    )
    aim = "struct<goal:int,m:int,lo:bigint,hi:bigint,at:bigint>"
    placed = ranges.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        rank, f"{key_types}, totals array<bigint>, known array<bigint>, aims array<{aim}>"
    )
    # a stage is one row already; all uses of this table share the exchange, as long as none of them takes less of the row
    return placed.groupBy(*keys).agg(F.any_value(F.struct("totals", "known", "aims")).alias("goals"))


def narrowed(tasks: DataFrame, goals: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """``found`` per stage with open ranks: their values, from a second read of the tasks."""
    open_goals = goals.select(*keys, "goals.aims").filter("size(aims) > 0")
    ranges = open_goals.selectExpr(*keys, "array_distinct(transform(aims, a -> struct(a.m AS m, a.lo AS lo, a.hi AS hi))) AS ranges")
    own = ", ".join(
        f"transform(filter(ranges, r -> r.m = {i} AND {column} BETWEEN r.lo AND r.hi), r -> struct(r.m AS m, r.lo AS lo, bigint({column}) AS v))"
        for i, column in enumerate(measures.values())
    )
    columns = dict.fromkeys(measures.values())
    inside = tasks.select(*keys, *columns).join(ranges, keys).selectExpr(*keys, f"inline(concat({own}))")
    counted = inside.groupBy(*keys, "m", "lo", "v").agg(F.count("*").alias("n"))
    in_range = f"PARTITION BY {', '.join(keys)}, m, lo ORDER BY v ROWS UNBOUNDED PRECEDING"
    located = counted.selectExpr("*", f"sum(n) OVER ({in_range}) - n AS before")
    aims = open_goals.selectExpr(*keys, "inline(aims)").select(*keys, "goal", "m", "lo", "at")
    hits = located.join(aims, [*keys, "m", "lo"]).filter("at >= before AND at < before + n")
    return hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("goal", "v"))).alias("found"))


def exact_quantiles(tasks: DataFrame, keys: list[str], measures: dict[str, str], digits: int = DIGITS) -> DataFrame:
    """Linear-interpolation quantiles truncated to integers: a five-slot array per stage and measure.

    Null values and tasks without a key do not count; a measure of nothing but nulls has null slots.
    """
    goals = rank_goals(tasks, keys, measures, digits)
    joined = goals.join(narrowed(tasks, goals, keys, measures), keys, "left")
    width = 2 * (QUARTERS + 1)

    def slot(m: int, quarter: int) -> str:
        goal = m * width + 2 * quarter
        lo, hi = (f"coalesce(goals.known[{g}], found[{g}])" for g in (goal, goal + 1))
        part = f"((goals.totals[{m}] - 1) * {quarter} % {QUARTERS}) / {QUARTERS}.0D"
        return f"bigint({lo} + {part} * ({hi} - {lo}))"

    arrays = [array_of(slot(i, q) for q in range(QUARTERS + 1)) + f" AS `{m}`" for i, m in enumerate(measures)]
    return joined.selectExpr(*keys, *arrays)
