"""Jaccard self-join of word-shingle sets with set-relation skipping.

Equal sets are one set from the start. Shingles have one global order, rarest first, and a set is filed under a prefix of
its shingles just long enough that two similar sets share one (the order needs no exact counts: it goes by a sketch
of fixed size that is added up over the whole corpus, then by hash). The lists of the index are answered in two steps:

1. In every list, one set of each size is the head, and a set is compared with the head that it meets in most of its lists.
   Near copies of a set, however many, cost a comparison each, and most fall into one component.
2. What is left are sets of different components in one list. Those next to the same large component are
   compared block by block, as products of small matrices that give out links, never pairs. For the others, a list is
   cut into blocks in order of set size and position of the shingle. How many shingles can still match after that position bounds the
   overlap, so whole pairs of blocks are skipped, as are those within one component. In the blocks left, the overlaps with a common
   head, known from step 1, and the tokens their prefixes share bound those of two sets: a set's answers follow from those of a
   highly similar one. Only sets with a pair between the bounds go on to be compared, again in blocks that give out links.

Every pair that links is found directly or lies in a component already, so components are exact (up to collisions of
64-bit hashes). Overlaps are counted on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.shared import block_of, configure, drop_written, hash_bitmap, leading_bits, per_batch, smallest_reachable, spanning_links, written

SHINGLE_WORDS = 3
# Similarity as a fraction of whole numbers, numerator and denominator, so that no rounding decides.
SIMILARITY = (90, 100)
SKETCH_BITS = 21
SLICES = 256
FILTER_BITS = 22
BLOCK_ROWS = 64
# Entries of a block of a list; units of two such blocks hold sizes, positions and prefixes only.
LIST_ROWS = 512
# Tokens of its prefix an entry carries, the first in order; what lies beyond only widens the bounds.
CARRIED_TOKENS = 64
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_of(text: str) -> list[bytes]:
    """Maximal runs without space, tab, line feed, vertical tab, form feed and carriage return; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of the whole text; with fewer words, one of the whole sequence."""
    words = words_of(text) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = hashes[: len(hashes) - size + 1].copy()
    for i in range(1, size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _A + hashes[i : len(hashes) - size + 1 + i] * _B
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _C
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def set_id(shingles: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63 if len(shingles) else None


def sets_and_sketch(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """``doc_id, n, sid`` of every document, and from each task the counts of shingles by leading hash bits.

    Count rows have ``slice`` and ``counts``, a compressed part of the sketch. A set counts once in a task.
    """
    width = (1 << bits) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        seen: set[int] = set()
        for batch in batches:
            n, sids = [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, size)
                sid = set_id(shingles)
                n.append(len(shingles))
                sids.append(sid)
                if sid is not None and sid not in seen:
                    seen.add(sid)
                    np.add.at(sketch, leading_bits(shingles.view(np.int64), bits), np.uint32(1))
            rows = len(n)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n": pa.array(n, pa.int64()),
                    "sid": pa.array(sids, pa.int64()),
                    "slice": pa.nulls(rows, pa.int32()),
                    "counts": pa.nulls(rows, pa.binary()),
                }
            )
        parts = [sketch[i * width : (i + 1) * width] for i in range(SLICES)]
        kept = [i for i, p in enumerate(parts) if p.any()]
        yield pa.record_batch(
            {
                "doc_id": pa.nulls(len(kept), pa.int64()),
                "n": pa.nulls(len(kept), pa.int64()),
                "sid": pa.nulls(len(kept), pa.int64()),
                "slice": pa.array(kept, pa.int32()),
                "counts": pa.array([pa.compress(parts[i].tobytes(), "zstd", asbytes=True) for i in kept], pa.binary()),
            }
        )

    schema = "doc_id bigint, n bigint, sid bigint, slice int, counts binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def summed_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The counts of all tasks added up, 2^bits of them whatever the corpus; a slice is added up as its rows stream by."""
    width = (1 << bits) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                raw = pa.decompress(counts, width * 4, "zstd", asbytes=True)
                totals.setdefault(number, np.zeros(width, np.uint64))
                totals[number] += np.frombuffer(raw, np.uint32)
        packed = [np.minimum(t, 2**32 - 1).astype(np.uint32).tobytes() for t in totals.values()]
        yield pa.record_batch({"slice": pa.array(list(totals), pa.int32()), "counts": pa.array(packed, pa.binary())})

    added = parts.select("slice", "counts").repartition("slice").mapInArrow(run, "slice int, counts binary")
    sketch = np.zeros(1 << bits, np.uint32)
    for row in added.toLocalIterator():
        sketch[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], np.uint32)
    return sketch


def prefix_index(docs: DataFrame, sketch: np.ndarray, size: int, bits: int, similarity: tuple[int, int]) -> DataFrame:
    """``token, sid, n, pos``: each set under its rarest shingles, positions from 1. A set is filed once in a task."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sketch)  # 4 * 2^bits bytes
    numerator, denominator = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        seen: set[int] = set()
        for batch in batches:
            tokens, owners, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, size)
                sid = set_id(shingles)
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                n = len(shingles)
                prefix = n - -(-numerator * n // denominator) + 1
                rank = counts[leading_bits(shingles.view(np.int64), bits)]
                # hashes are sorted: a stable sort by count leaves ties in hash order
                tokens.append(shingles[np.argsort(rank, kind="stable")[:prefix]])
                owners.append(sid)
                sizes.append(n)
            lengths = np.array([len(t) for t in tokens], np.int64)
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            pos = np.arange(1, len(flat) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.record_batch(
                {
                    "token": pa.array(flat),
                    "sid": pa.array(np.repeat(np.array(owners, np.int64), lengths)),
                    "n": pa.array(np.repeat(np.array(sizes, np.int64), lengths)),
                    "pos": pa.array(pos, pa.int64()),
                }
            )

    return docs.select("text").mapInArrow(run, "token bigint, sid bigint, n bigint, pos bigint")


def needed_overlap(a: str, b: str, similarity: tuple[int, int]) -> str:
    """SQL for the smallest overlap at which sets of sizes ``a`` and ``b`` link."""
    numerator, total = similarity[0], sum(similarity)
    return f"(({numerator} * ({a} + {b}) + {total - 1}) DIV {total})"


def plausible(pairs: DataFrame, prefixes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``a, b`` of the pairs whose prefixes share enough; ``prefixes`` has ``sid, n, tokens``, the tokens in any list.

    Of two prefixes, one ends no later in the order. All shingles in common up to there are in both prefixes, and after it
    that set has ``n`` less its prefix left, so the overlap is at most the tokens in common plus the larger rest.
    """

    numerator, denominator = similarity

    def rest(n: str) -> str:
        return f"(({numerator} * {n} + {denominator - 1}) DIV {denominator} - 1)"

    both = pairs.select("a", "b").join(prefixes.selectExpr("sid AS a", "n AS na", "tokens AS ta"), "a")
    both = both.join(prefixes.selectExpr("sid AS b", "n AS nb", "tokens AS tb"), "b")
    most = f"size(array_intersect(ta, tb)) + greatest({rest('na')}, {rest('nb')})"
    return both.filter(f"{most} >= {needed_overlap('na', 'nb', similarity)}").select("a", "b")


def shingles_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``sid, shingles`` of the wanted sets, read from one document each; some others may come with them.

    A bitmap of fixed size keeps most other documents' sets from being made, so nothing is shuffled here.
    """
    chosen = reps.join(wanted.distinct(), "sid").select(F.xxhash64("doc_id").alias("mark"))
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(hash_bitmap(chosen, FILTER_BITS)))

    def make():
        flags = np.unpackbits(sent.value).astype(bool)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept = np.flatnonzero(flags[leading_bits(batch.column("mark").to_numpy(), FILTER_BITS)])
            sets = [shingle_set(t, size) for t in batch.column("text").take(pa.array(kept, pa.int64())).to_pylist()]
            sets = [s for s in sets if len(s)]
            return pa.record_batch(
                {
                    "sid": pa.array([set_id(s) for s in sets], pa.int64()),
                    "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                }
            )

        return step

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("text", F.xxhash64(F.col("doc_id").cast("bigint")).alias("mark"))
    return written(per_batch(rows, "sid bigint, shingles binary", make), "shingles")


def overlaps(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """``a, b, na, nb, o``: sizes and overlap of the sets of every pair."""
    both = pairs.select("a", "b").join(shingles.selectExpr("sid AS a", "shingles AS sa"), "a")
    both = both.join(shingles.selectExpr("sid AS b", "shingles AS sb"), "b").select("a", "b", "sa", "sb")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            na, nb, o = [], [], []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                na.append(len(x))
                nb.append(len(y))
                at = np.searchsorted(y, x)
                o.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
            return pa.record_batch(
                {
                    "a": batch.column("a"),
                    "b": batch.column("b"),
                    "na": pa.array(na, pa.int64()),
                    "nb": pa.array(nb, pa.int64()),
                    "o": pa.array(o, pa.int64()),
                }
            )

        return step

    return per_batch(both, "a bigint, b bigint, na bigint, nb bigint, o bigint", make)


def links(similarity: tuple[int, int]) -> str:
    """SQL: whether sets of sizes ``na`` and ``nb`` with the overlap ``o`` link."""
    numerator, denominator = similarity
    return f"{denominator} * o >= {numerator} * (na + nb - o)"


def may_link(a: str, b: str, similarity: tuple[int, int]) -> str:
    """SQL: whether sets with a shingle in common, after which ``n - pos`` more can match, can still link."""
    numerator, denominator = similarity
    return (
        f"{denominator} * least({a}_n, {b}_n) >= {numerator} * greatest({a}_n, {b}_n)"
        f" AND 1 + least({a}_n - {a}_pos, {b}_n - {b}_pos) >= {needed_overlap(f'{a}_n', f'{b}_n', similarity)}"
    )


def in_lists_of_several(entries: DataFrame, column: str) -> DataFrame:
    """The entries whose list holds several values of ``column``; they are shuffled once, by token."""
    listed = Window.partitionBy("token")
    ends = {"lo": F.min(column).over(listed), "hi": F.max(column).over(listed)}
    return entries.withColumns(ends).filter("lo < hi").drop("lo", "hi")


def mixed_lists(lists: DataFrame, components: DataFrame) -> DataFrame:
    """``token, sid, n, pos, component`` of the lists that hold sets of several components."""
    labelled = lists.join(components.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "component", F.coalesce("component", "sid")
    )
    return written(in_lists_of_several(labelled, "component"), "mixed-lists")


def size_band(similarity: tuple[int, int]) -> Column:
    """Sets that link are of the same band or of adjacent ones."""
    return F.floor(F.log("n") / np.log(similarity[1] / similarity[0]))


def near_in_size(lists: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The entries whose list holds another set of their own size band or an adjacent one."""
    banded = lists.withColumn("band", size_band(similarity))
    held = banded.groupBy("token", "band").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    around = held.select("token", F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"), "lo", "hi")
    around = around.groupBy("token", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
    return banded.join(around.select("token", "band"), ["token", "band"], "left_semi").drop("band")


def head_pairs(lists: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``a, b``: every set with a head of one of its lists that may link to it.

    A list has a head for each band of set sizes, by a hash; a set meets those of its own band and the adjacent ones.
    """
    banded = lists.withColumn("band", size_band(similarity))
    heads = banded.groupBy("token", "band").agg(F.max(F.struct(F.xxhash64("sid").alias("first"), "sid", "n", "pos")).alias("h"))
    heads = heads.select("token", F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"), "h")
    heads = heads.selectExpr("token", "band", "h.sid AS b", "h.n AS b_n", "h.pos AS b_pos")
    entries = banded.selectExpr("token", "band", "sid AS a", "n AS a_n", "pos AS a_pos")
    met = entries.join(heads, ["token", "band"]).filter("a <> b").filter(may_link("a", "b", similarity)).groupBy("a", "b").count()
    # one comparison for a set, with the head it meets in most lists; later steps see to the others
    best = met.groupBy("a").agg(F.max(F.struct("count", "b")).alias("best")).selectExpr("a", "best.b AS b")
    return best.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()


def pivots_of(known: DataFrame, components: DataFrame) -> DataFrame:
    """``sid, pivot``: the largest of a set's own component and those of the sets it was compared with."""
    sided = known.selectExpr("a AS sid", "b AS node").union(known.selectExpr("b AS sid", "a AS node"))
    sided = sided.union(sided.selectExpr("sid", "sid AS node").distinct()).join(components, "node", "left")
    sided = sided.select("sid", F.coalesce("component", "node").alias("component"))
    sizes = components.groupBy("component").count()
    best = F.max(F.struct(F.coalesce("count", F.lit(1)).alias("size"), "component")).alias("best")
    return sided.join(sizes, "component", "left").groupBy("sid").agg(best).selectExpr("sid", "best.component AS pivot")


def pivot_units(members: DataFrame, shingles: DataFrame, block_rows: int) -> DataFrame:
    """``members`` of each unit: a block of the sets outside the pivot's largest component, and a block of any sets."""
    parts = members.groupBy("pivot", "component").count()
    largest = parts.groupBy("pivot").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("n_all"))
    sizes = largest.filter("top.count < n_all").select(
        "pivot",
        F.col("top.component").alias("main"),
        F.ceil((F.col("n_all") - F.col("top.count")) / block_rows).alias("left_blocks"),
        F.ceil(F.col("n_all") / block_rows).alias("right_blocks"),
    )
    rows = members.join(sizes, "pivot")
    left = rows.filter("component <> main").select(
        "pivot", "sid", "component", F.lit(True).alias("left"),
        block_of(F.col("sid"), F.col("left_blocks")).alias("left_block"),
        F.explode(F.expr("sequence(0L, right_blocks - 1)")).alias("right_block"),
    )
    right = rows.select(
        "pivot", "sid", "component", F.lit(False).alias("left"),
        F.explode(F.expr("sequence(0L, left_blocks - 1)")).alias("left_block"),
        block_of(F.col("sid"), F.col("right_blocks")).alias("right_block"),
    )
    both = left.union(right).join(shingles.dropDuplicates(["sid"]), "sid")
    # two blocks at most meet in a unit, so its list is bounded
    row = F.struct("left", "sid", "component", "shingles")
    return both.groupBy("pivot", "left_block", "right_block").agg(F.collect_list(row).alias("members")).select("members")


def overlap_matrix(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap of every left set with every right one, by products of the incidence matrices of shared shingles."""
    sets = left + right
    lengths = [len(s) for s in sets]
    flat = np.concatenate(sets)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    number, owner = number[shared], np.repeat(np.arange(len(sets)), lengths)[shared]
    _, number = np.unique(number, return_inverse=True)
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    top = int(number[-1]) + 1 if len(number) else 0
    for start in range(0, top, 8192):
        low, high = np.searchsorted(number, [start, start + 8192])
        incidence = np.zeros((len(sets), 8192), np.float32)
        incidence[owner[low:high], number[low:high] - start] = 1
        total += incidence[: len(left)] @ incidence[len(left) :].T
    return total.astype(np.int64)


def unit_links(units: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``a, b``: links that connect what links between different components within the units connect."""
    numerator, denominator = similarity

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            for members in batch.column("members"):
                rows = members.values
                side = rows.field("left").to_numpy(zero_copy_only=False).astype(bool)
                sid, component = rows.field("sid").to_numpy(), rows.field("component").to_numpy()
                sets = [np.frombuffer(s, np.uint64) for s in rows.field("shingles").to_pylist()]
                left, right = np.flatnonzero(side), np.flatnonzero(~side)
                if not len(left) or not len(right):
                    continue
                o = overlap_matrix([sets[i] for i in left], [sets[i] for i in right])
                n = np.array([len(s) for s in sets])
                together = n[left][:, None] + n[right][None, :] - o
                linked = (denominator * o >= numerator * together) & (component[left][:, None] != component[right][None, :])
                if linked.any():
                    found += spanning_links(linked, sid[left], sid[right])
            a, b = zip(*found) if found else ((), ())
            return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return step

    return per_batch(units, "a bigint, b bigint", make)


def open_units(mixed: DataFrame, members: DataFrame, similarity: tuple[int, int], rows: int) -> DataFrame:
    """``members`` of each unit: two blocks of a list that may hold a link between different components.

    A list is cut, in order of set size and position, into blocks of about ``rows`` entries; equal entries are dealt to the blocks
    they span by hash. How many shingles can still match after the position bounds the overlap, so most pairs of blocks
    are skipped. An entry is shipped once for each block its own meets.
    """
    groups = mixed.groupBy("token", "n", "pos").count()
    groups = groups.withColumn(
        "before", F.expr("sum(count) OVER (PARTITION BY token ORDER BY n, pos ROWS UNBOUNDED PRECEDING) - count")
    )
    entries = mixed.join(groups, ["token", "n", "pos"]).withColumn(
        "block", F.expr(f"(before + pmod(xxhash64(sid), count)) DIV {rows}")
    )
    entries = written(entries.select("token", "block", "sid", "n", "pos", "component"), "open-lists")
    blocks = entries.groupBy("token", "block").agg(
        F.min("n").alias("n"), F.max("n").alias("top_n"), F.max(F.expr("n - pos")).alias("rest"),
        F.min("component").alias("lo"), F.max("component").alias("hi"),
    )
    columns = ("block", "n", "top_n", "rest", "lo", "hi")
    first = blocks.select("token", *[F.col(c).alias(f"a_{c}") for c in columns])
    second = blocks.select("token", *[F.col(c).alias(f"b_{c}") for c in columns])
    numerator, denominator = similarity
    kept = first.join(second, "token").filter(
        f"a_block <= b_block AND {denominator} * a_top_n >= {numerator} * b_n"
        f" AND 1 + least(a_rest, b_rest) >= {needed_overlap('a_n', 'b_n', similarity)}"
        " AND NOT (a_lo = a_hi AND b_lo = b_hi AND a_lo = b_lo)"
    )
    kept = written(kept.select("token", "a_block", "b_block"), "open-blocks")
    left = entries.withColumnRenamed("block", "a_block").join(kept, ["token", "a_block"]).withColumn("left", F.lit(True))
    right = entries.withColumnRenamed("block", "b_block").join(kept, ["token", "b_block"]).withColumn("left", F.lit(False))
    both = left.unionByName(right).join(members, "sid")
    both = both.withColumn("earlier", F.expr("size(filter(places, p -> p < pos))")).drop("places")
    row = F.struct("left", "sid", "n", "pos", "component", "pivot", "head", "head_n", "head_o", "tokens", "earlier", "beyond")
    return both.groupBy("token", "a_block", "b_block").agg(F.collect_list(row).alias("members"))


def block_members(lists: DataFrame, pivots: DataFrame, known: DataFrame) -> DataFrame:
    """What a unit must know of a set: ``pivot``, its prefix in order, and the set most like it among those it was compared with."""
    prefixes = lists.groupBy("sid").agg(F.array_sort(F.collect_set(F.struct("pos", "token"))).alias("p"))
    carried = f"slice(p, 1, {CARRIED_TOKENS})"
    prefixes = prefixes.selectExpr(
        "sid", f"{carried}.token AS tokens", f"{carried}.pos AS places", f"greatest(size(p) - {CARRIED_TOKENS}, 0) AS beyond"
    )
    sided = known.selectExpr("a AS sid", "b AS head", "nb AS head_n", "o").union(
        known.selectExpr("b AS sid", "a AS head", "na AS head_n", "o")
    )
    nearest = sided.groupBy("sid").agg(F.max(F.struct("o", "head", "head_n")).alias("h"))
    nearest = nearest.selectExpr("sid", "h.head AS head", "h.head_n AS head_n", "h.o AS head_o")
    return prefixes.join(pivots, "sid", "left").join(nearest, "sid", "left").withColumn("pivot", F.coalesce("pivot", "sid"))


def still_open(units: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Per unit its ``sid`` rows with a pair that may link, or rows ``a, b`` of links that are certain already.

    A pair is seen to in no list after that of the first carried shingle both have, and not if both have one pivot. With a common ``head``
    of size h and overlaps x and y, it shares at least x + y - h and at most what fits inside and outside of the head; tokens
    common to the prefixes bound the overlap too.
    """
    numerator, denominator = similarity

    def rest(n: np.ndarray) -> np.ndarray:
        return -(-numerator * n // denominator) - 1

    def settle(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of both sides, pairs that may link, pairs that do."""
        side = rows.field("left").to_numpy(zero_copy_only=False).astype(bool)
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        n, pos, component, pivot = (rows.field(c).to_numpy() for c in ("n", "pos", "component", "pivot"))
        head, head_n, head_o = (rows.field(c).fill_null(0).to_numpy() for c in ("head", "head_n", "head_o"))
        alone = rows.field("head").is_null().to_numpy(zero_copy_only=False)

        def each(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return values[left][:, None], values[right][None, :]

        (na, nb), (ca, cb), (pa_, pb), (ra, rb) = each(n), each(component), each(pivot), each(n - pos)
        need = -(-numerator * (na + nb) // (numerator + denominator))
        may = (ca != cb) & (pa_ != pb) & (1 + np.minimum(ra, rb) >= need)
        may &= denominator * np.minimum(na, nb) >= numerator * np.maximum(na, nb)
        sure = np.zeros_like(may)
        if may.any():
            tokens = [np.asarray(t, np.int64).view(np.uint64) for t in rows.field("tokens").to_pylist()]
            before = [t[:e] for t, e in zip(tokens, rows.field("earlier").to_pylist())]
            may &= overlap_matrix([before[i] for i in left], [before[i] for i in right]) == 0
            common = overlap_matrix([tokens[i] for i in left], [tokens[i] for i in right])
            ba, bb = each(rows.field("beyond").to_numpy())
            may &= common + ba + bb + np.maximum(rest(na), rest(nb)) >= need
            (ha, hb), (xa, xb), (size, _), (aa, ab) = each(head), each(head_o), each(head_n), each(alone)
            shared = (ha == hb) & ~aa & ~ab
            sure = may & shared & (xa + xb - size >= need)
            may &= ~sure & ~(shared & (np.minimum(xa, xb) + np.minimum(na - xa, nb - xb) < need))
        return left, right, may, sure

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {c: [] for c in ("token", "a_block", "b_block", "left", "sid", "component", "a", "b")}
            keys = zip(*(batch.column(c).to_pylist() for c in ("token", "a_block", "b_block")))
            for key, members in zip(keys, batch.column("members")):
                rows = members.values
                sid, component = rows.field("sid").to_numpy(), rows.field("component").to_numpy()
                left, right, may, sure = settle(rows)
                found = spanning_links(sure, sid[left], sid[right]) if sure.any() else []
                kept = [(True, i) for i in left[may.any(axis=1)]] + [(False, i) for i in right[may.any(axis=0)]]
                for name, value in zip(("token", "a_block", "b_block"), key):
                    out[name] += [value] * (len(kept) + len(found))
                out["left"] += [x for x, _ in kept] + [None] * len(found)
                out["sid"] += [int(sid[i]) for _, i in kept] + [None] * len(found)
                out["component"] += [int(component[i]) for _, i in kept] + [None] * len(found)
                out["a"] += [None] * len(kept) + [a for a, _ in found]
                out["b"] += [None] * len(kept) + [b for _, b in found]
            kinds = {"left": pa.bool_()}
            return pa.record_batch({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

        return step

    schema = "token bigint, a_block bigint, b_block bigint, left boolean, sid bigint, component bigint, a bigint, b bigint"
    return per_batch(units, schema, make)


def exact_units(open_rows: DataFrame, shingles: DataFrame, block_rows: int) -> DataFrame:
    """``members`` of units of at most two blocks of ``block_rows`` of what is open, with their shingles."""
    unit = ["token", "a_block", "b_block"]
    sizes = open_rows.groupBy(*unit).agg(
        F.ceil(F.count_if("left") / block_rows).alias("left_blocks"), F.ceil(F.count_if(~F.col("left")) / block_rows).alias("right_blocks")
    )
    rows = open_rows.select(*unit, "left", "sid", "component").join(sizes, unit)
    own = F.when(F.col("left"), block_of(F.col("sid"), F.col("left_blocks"))).otherwise(block_of(F.col("sid"), F.col("right_blocks")))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0L, if(left, right_blocks, left_blocks) - 1)")))
    rows = rows.withColumns({"x": F.expr("if(left, own, other)"), "y": F.expr("if(left, other, own)")})
    rows = rows.join(shingles.dropDuplicates(["sid"]), "sid")
    row = F.struct("left", "sid", "component", "shingles")
    return rows.groupBy(*unit, "x", "y").agg(F.collect_list(row).alias("members")).select("members")


def joined_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links."""
    if links.isEmpty():
        return components
    spanning = components.filter("node <> component").selectExpr("node AS a", "component AS b")
    return written(smallest_reachable(links.select("a", "b").union(spanning)), "components")


def shingle_components(
    docs: DataFrame, size: int = SHINGLE_WORDS, bits: int = SKETCH_BITS, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Two documents link when the Jaccard similarity of their sets of shingles of ``size`` words is at least the fraction
    ``similarity``; a text of fewer words than a shingle has one of all its words. Null texts and texts without words have an empty set and link with nothing. The
    component is the smallest id reachable by links; rows with equal sets, repeated rows too, are one component. A null id
    has a null component unless its text links to a row with an id. Other columns are ignored; an empty table gives no rows.
    """
    configure(docs.sparkSession)
    passed = written(sets_and_sketch(docs, size, bits), "sets")
    sketch = summed_sketch(passed.filter("slice IS NOT NULL"), bits)
    sets = passed.filter("n IS NOT NULL").select("doc_id", "n", "sid")
    reps = sets.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))

    index = written(prefix_index(docs, sketch, size, bits, similarity), "index")
    lists = written(in_lists_of_several(index, "sid").distinct(), "lists")
    drop_written(index)
    lists = written(near_in_size(lists, similarity), "near-lists")
    # as many tokens as a set's prefix has
    prefixes = written(lists.groupBy("sid", "n").agg(F.collect_set("token").alias("tokens")), "prefixes")

    pairs = written(plausible(head_pairs(lists, similarity), prefixes, similarity), "head-pairs")
    found = shingles_of(docs, reps, pairs.selectExpr("a AS sid").union(pairs.selectExpr("b AS sid")), size)
    known = written(overlaps(pairs, found), "overlaps")
    components = written(smallest_reachable(known.filter(links(similarity)).select("a", "b")), "components")
    mixed = mixed_lists(lists, components)

    # sets next to one component, their pivot, are compared in blocks: those outside it with all
    pivots = written(pivots_of(known, components), "pivots")
    members = mixed.select("sid", "component").distinct().join(pivots, "sid")
    members = written(members, "pivot-members")
    several = members.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    members = members.join(several.select("pivot"), "pivot", "left_semi")
    found = shingles_of(docs, reps, members.select("sid"), size)
    more = written(unit_links(pivot_units(members, found, BLOCK_ROWS), similarity), "pivot-links")
    components = joined_components(components, more)
    mixed = mixed_lists(lists, components)

    units = open_units(mixed, block_members(lists, pivots, known), similarity, LIST_ROWS)
    settled = written(still_open(units, similarity), "settled")
    unsure = settled.filter("sid IS NOT NULL")
    found = shingles_of(docs, reps, unsure.select("sid"), size)
    more = unit_links(exact_units(unsure, found, BLOCK_ROWS), similarity).union(settled.filter("sid IS NULL").select("a", "b"))
    components = joined_components(components, written(more, "more-links"))

    groups = reps.join(components.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "doc_id", F.coalesce("component", "sid").alias("component")
    )
    smallest = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = groups.join(smallest, "component").select("sid", "component_id")
    return sets.join(of_set, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
