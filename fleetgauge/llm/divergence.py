"""How the sources of a language differ in their words: smoothed shares of terms, compared exactly.

A document's terms are counted in the tasks that read it, by (language, source), and sums are combined before they are shuffled, so a
source with a third of all documents costs what its distinct terms cost. A language keeps the terms of at least ``min_documents`` of
its documents. A group is a (language, source) that occurs; its share of a term with n of its N kept words, of V kept terms, is
``p = 1 + floor(10^9 (n + 5) / (N + 5 V))``, in whole numbers throughout.

Sources of a language are compared in units: a square of two row tiles (``TILE_GROUPS`` groups each) by one block of terms
(by hash, about ``BLOCK_CELLS`` nonzero cells). A unit's count matrix is a quadtree: a quadrant without any count is not stored
and splits no further. All pairs of groups walk down it together, level by level. Where both have no count in a quadrant, all of its
terms differ by the same amount, the difference of the shares of a count of 0, times the quadrant's width; at cells the shares
are compared. Units give one number per pair, so what is shuffled does not depend on the number of terms.

Null texts, languages and sources are ''. Groups without kept terms take part (all their counts are 0); a language without kept
terms has differences of 0. Ties rank by item in UTF-8 order. Repeated rows are documents of their own. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.shared import configure, word_chunks, written

TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
TILE_GROUPS = 64
BLOCK_CELLS = 20_000
# Terms a task counts before it hands them on, and cells of the frontier of a walk.
HELD_TERMS = 400_000
FRONTIER = 1_000_000

_COUNTS = "lang string, source string, term string, n bigint, n_docs bigint"
_RESULT = "lang string, source string, part string, item string, value bigint, rank int"


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, n_docs``: partial sums over ``docs(lang, source, text)``; a null term marks a group."""

    def emit(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, spread) in held.items():
            size = len(counts)
            columns = {
                "lang": pa.DictionaryArray.from_arrays(np.zeros(size + 1, np.int32), [lang]).cast(pa.string()),
                "source": pa.DictionaryArray.from_arrays(np.zeros(size + 1, np.int32), [source]).cast(pa.string()),
                "term": pa.array([None, *(t.decode() for t in counts)], pa.string()),
                "n": pa.array([0, *counts.values()], pa.int64()),
                "n_docs": pa.array([0, *map(spread.__getitem__, counts)], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(n).to_pylist() for n in ("lang", "source", "text"))):
                counts, spread = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for words in word_chunks(text, TERM):
                    counts.update(words)
                    own.update(words)
                spread.update(own)
            if sum(len(counts) for counts, _ in held.values()) > HELD_TERMS:
                yield from emit(held)
                held = {}
        yield from emit(held)

    rows = docs.select(*(F.coalesce(F.col(n), F.lit("")).alias(n) for n in ("lang", "source", "text")))
    return rows.mapInArrow(run, _COUNTS)


def share(n: str, total: str, terms: str) -> str:
    """``p`` as an SQL expression."""
    return f"1 + (cast({SCALE} AS decimal(10,0)) * ({n} + {SMOOTHING})) DIV ({total} + {SMOOTHING} * {terms})"


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``p`` of counts and their ``N + 5 V``: long division by thousands, so that nothing exceeds 64 bits."""
    if totals.size and totals.max() >= 1 << 53:
        raise ValueError("a group of more than 2^53 words")
    left = counts + SMOOTHING
    found = left // totals
    for _ in range(3):
        left = left % totals * 1000
        found = found * 1000 + left // totals
    return found + 1


class Quadtree:
    """The nonzero quadrants of a matrix, each split in four: per level from the root, a node's four children or -1."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, height: int):
        self.height = height
        codes = [np.unique((rows >> s) << 32 | columns >> s) for s in range(height + 1)]
        self.cells = codes[0]
        self.children = [np.zeros((0, 4), np.int64)]
        for below, above in zip(codes, codes[1:]):
            row, column = below >> 32, below & 0xFFFFFFFF
            # one row more than nodes: -1, the quadrant without counts, has only such children
            table = np.full((len(above) + 1, 4), -1, np.int64)
            table[np.searchsorted(above, (row >> 1) << 32 | column >> 1), (row & 1) << 1 | column & 1] = np.arange(len(below))
            self.children.append(table)
        self.root = 0 if len(rows) else -1

    def cell_of(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cells, rows << 32 | columns)


def differences(
    tree: Quadtree, at_zero: np.ndarray, cell_shares: np.ndarray, width: int, left: np.ndarray, right: np.ndarray
) -> np.ndarray:
    """Sum over ``width`` columns of the differences of shares of the rows ``left`` and ``right``, pair by pair."""
    value = np.zeros(len(left), np.int64)
    apart = np.abs(at_zero[left] - at_zero[right])
    pair = np.arange(len(left))
    a = b = np.full(len(left), tree.root)
    column = np.zeros(len(left), np.int64)
    for level in range(tree.height, -1, -1):
        bare = (a < 0) & (b < 0)
        covered = np.minimum((column + 1) << level, width) - np.minimum(column << level, width)
        np.add.at(value, pair[bare], (covered * apart[pair])[bare])
        a, b, pair, column = a[~bare], b[~bare], pair[~bare], column[~bare]
        if level:
            below = tree.children[level]
            row_a, row_b = (left[pair] >> level - 1) & 1, (right[pair] >> level - 1) & 1
            a, b = (np.concatenate([below[n, r << 1], below[n, r << 1 | 1]]) for n, r in ((a, row_a), (b, row_b)))
            pair, column = np.concatenate([pair, pair]), np.concatenate([column << 1, column << 1 | 1])
    p = np.where(a < 0, at_zero[left[pair]], np.append(cell_shares, 0)[a])
    q = np.where(b < 0, at_zero[right[pair]], np.append(cell_shares, 0)[b])
    np.add.at(value, pair, np.abs(p - q))
    return value


def compare_unit(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial differences of all pairs of a unit's groups, both ways."""
    out = {"lang": [], "source": [], "item": [], "value": []}
    if groups.num_rows:
        groups = groups.sort_by("row").combine_chunks()
        row_ids, tiles = groups["row"].to_numpy(), groups["tile"].to_numpy()
        width = groups["width"][0].as_py()
        totals = groups["total"].to_numpy() + SMOOTHING * groups["terms"].to_numpy()
        at_zero = np.zeros(len(totals), np.int64) if not width else shares(np.zeros_like(totals), totals)
        rows = np.searchsorted(row_ids, cells["cell_row"].to_numpy())
        columns = cells["term"].combine_chunks().dictionary_encode()
        columns = (columns.combine_chunks() if isinstance(columns, pa.ChunkedArray) else columns).indices.to_numpy().astype(np.int64)
        height = int(max(len(totals), width, 1) - 1).bit_length()
        tree = Quadtree(rows, columns, height)
        order = np.argsort(tree.cell_of(rows, columns))
        cell_shares = shares(cells["n"].to_numpy()[order], totals[rows[order]])
        left, right = np.triu_indices(len(totals), 1)
        if tiles[0] != tiles[-1]:  # pairs within a tile belong to the tile's own unit
            across = tiles[left] != tiles[right]
            left, right = left[across], right[across]
        step = max(1, FRONTIER // max(1, width))
        parts = [
            differences(tree, at_zero, cell_shares, width, left[i : i + step], right[i : i + step])
            for i in range(0, len(left), step)
        ]
        value = np.concatenate([np.zeros(0, np.int64), *parts])
        names = groups["source"].combine_chunks()
        names = names if isinstance(names, pa.Array) else pa.concat_arrays(names.chunks)
        one, other = names.take(pa.array(left)), names.take(pa.array(right))
        out = {
            "lang": pa.array([groups["lang"][0].as_py()] * (2 * len(left)), pa.string()),
            "source": pa.concat_arrays([one, other]).cast(pa.string()),
            "item": pa.concat_arrays([other, one]).cast(pa.string()),
            "value": pa.array(np.concatenate([value, value])),
        }
    fields = [("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]
    return pa.table(out, schema=pa.schema(fields))


def audit_sources(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    top_terms: int = TOP_TERMS,
    tile_groups: int = TILE_GROUPS,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: each group against the others of its language (``pair``), and the terms it uses
    more than its language does (``term``, the first ``top_terms``)."""
    configure(docs.sparkSession)
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    counts = written(counts, "terms")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("spread"))
    kept = written(kept.filter(F.col("spread") >= min_documents).drop("spread"), "kept")
    cells = written(counts.filter("term IS NOT NULL").join(kept, ["lang", "term"]).drop("n_docs"), "cells")

    languages = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left")
    groups = groups.join(languages, "lang", "left").fillna(0, ["total", "used", "terms", "lang_total"])
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumns(
        {
            "row": F.row_number().over(of_lang.orderBy("source")).cast("bigint") - 1,
            "tiles": F.ceil(F.count("*").over(of_lang) / tile_groups).cast("bigint"),
            "blocks": F.ceil(F.greatest(F.sum("used").over(of_lang), F.lit(1)) / block_cells).cast("bigint"),
        }
    ).withColumn("tile", F.expr(f"row DIV {tile_groups}"))
    groups = written(groups, "groups")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    p, q = share("n", "total", "terms"), share("lang_n", "lang_total", "terms")
    terms = cells.join(groups, ["lang", "source"]).selectExpr("lang", "source", "term AS item", f"{p} AS p", f"{q} AS q")
    terms = terms.filter("p > q").selectExpr("lang", "source", "'term' AS part", "item", "p - q AS value")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms)

    pairs = pair_differences(cells, kept, groups)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(terms)


def pair_differences(cells: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: each unit's part of the difference of two groups."""
    block = "pmod(xxhash64(term), blocks) AS block"
    unit = ["lang", "low", "high", "block"]
    other = "explode(sequence(0L, tiles - 1)) AS other"
    tiled = ("least(tile, other) AS low", "greatest(tile, other) AS high")
    per_lang = groups.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    widths = kept.join(per_lang, "lang").selectExpr("lang", block).groupBy("lang", "block").agg(F.count("*").alias("width"))

    members = groups.selectExpr("*", other).selectExpr("*", *tiled, "explode(sequence(0L, blocks - 1)) AS block")
    members = members.join(widths, ["lang", "block"], "left").fillna(0, ["width"])
    members = members.select(*unit, "source", "row", "tile", "total", "terms", "width")
    found = cells.join(groups.drop("total"), ["lang", "source"]).selectExpr("lang", "row", "tile", "tiles", "term", "n", block)
    found = found.selectExpr("*", other).selectExpr("lang", *tiled, "block", "row AS cell_row", "term", "n")
    return (
        found.groupBy(*unit)
        .cogroup(members.groupBy(*unit))
        .applyInArrow(compare_unit, "lang string, source string, item string, value bigint")
    )
