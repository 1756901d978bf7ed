"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the centred, principal-component space is learned on a bounded sample so that the signs of the rotated
coordinates lose as little as possible; the signs are a balanced 64-bit code. Codes are cut into four substrings of 16
bits, one table each. Two vectors are candidates if some substring differs in at most two bits, which any two codes that
differ in up to eleven bits fulfil. Candidates are compared by the cosine of their original vectors. Subtracting a mean that all
vectors share widens the angles between them, so only as much of it goes as leaves pairs planted at the threshold candidates.

A vector is filed under its substring in every table (at home) and visits the buckets of smaller substrings up to two bits
away, so every candidate pair meets in some bucket. It is counted only where it meets first: in the lowest
table in which it is a candidate, in the bucket of the smaller substring. Buckets are dealt into blocks by the hash of the
id; a pair of blocks is one unit of work, a product of two small matrices. Units give out link counts and a spanning set
of links, never pairs, so a bucket with a third of all vectors is spread over many tasks. Equal vectors are one vector
with a weight before any of this. Units are worked off in rounds, so that what they ship lies on the disk a part at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import block_of, configure, per_batch, smallest_reachable, spanning_links, written, written_in_turn

BITS, TABLES = 64, 4
PART = BITS // TABLES
PROBE_BITS = 2
# Changes of a substring in up to PROBE_BITS bits.
PROBES = [m for m in range(1, 2**PART) if m.bit_count() <= PROBE_BITS]
# Parts of the mean that are tried, and the share of the planted pairs that must be candidates.
CENTRING = (1.0, 0.75, 0.5, 0.25, 0.0)
PLANTED_RECALL = 0.95
SAMPLE_ROWS = 8000
ITERATIONS = 40
BLOCK_ROWS = 256
COSINE = 0.93
# Members of units carry their vectors, each many times over. What the units of a round ship is about ROUND_BYTES, a member counting for its
# vector and MEMBER_BYTES; a bucket of more than a WIDE_SHAREth of a round is spread over rounds.
ROUND_BYTES = 1 << 30
MEMBER_BYTES = 256
WIDE_SHARE = 8
_SUBSTRING = f"(tab * {2**PART}L + part)"


@dataclass(frozen=True)
class Quantiser:
    mean: np.ndarray
    projection: np.ndarray  # coordinates by bits

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """64-bit codes of unit vectors, one per row."""
        bits = ((unit - self.mean) @ self.projection) > 0
        padded = np.zeros((len(unit), BITS), bool)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel()


def candidates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of codes agree in some substring but for ``PROBE_BITS`` bits."""
    mask = np.uint64(2**PART - 1)
    different = a ^ b
    near = [np.bitwise_count(different >> np.uint64(PART * tab) & mask) <= PROBE_BITS for tab in range(TABLES)]
    return np.logical_or.reduce(near)


def planted_near(sample: np.ndarray, mean: np.ndarray, cosine: float, generator: np.random.Generator) -> np.ndarray:
    """For each unit vector another at the given cosine that shares its part along the mean, as near as can be."""
    length = np.sqrt(mean @ mean)
    along = (sample @ mean)[:, None] * mean / length**2 if length > 0 else np.zeros_like(sample)
    rest = sample - along
    left = (rest * rest).sum(axis=1, keepdims=True)
    turn = np.clip((cosine - 1 + left) / np.maximum(left, 1e-12), -1, 1)
    away = generator.normal(size=sample.shape)
    away -= (away @ mean)[:, None] * mean / length**2 if length > 0 else 0
    away -= (away * rest).sum(axis=1, keepdims=True) * rest / np.maximum(left, 1e-12)
    away *= np.sqrt(left) / np.maximum(np.sqrt((away * away).sum(axis=1, keepdims=True)), 1e-12)
    return along + turn * rest + np.sqrt(1 - turn * turn) * away


def fit_quantiser(sample: np.ndarray, iterations: int = ITERATIONS, seed: int = 5, cosine: float = COSINE) -> Quantiser:
    """The quantiser with the most of the mean subtracted that still finds pairs planted at ``cosine``."""
    size = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(size)
    near = planted_near(sample, mean, cosine, np.random.default_rng(seed))
    for share in CENTRING:
        quantiser = _rotated(sample, share * mean, iterations, seed)
        if candidates(quantiser.codes(sample), quantiser.codes(near)).mean() >= PLANTED_RECALL:
            break
    return quantiser


def _rotated(sample: np.ndarray, mean: np.ndarray, iterations: int, seed: int) -> Quantiser:
    """Iterative quantisation: alternate between the nearest codes and the rotation that best maps onto them.

    With fewer coordinates than bits, several rotations from different starts fill the code.
    """
    size = sample.shape[1]
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred / max(1, len(sample)))
    generator = np.random.default_rng(seed)
    projections = []
    for start in range(0, BITS, size):
        width = min(size, BITS - start)
        basis = axes[:width].T
        low = centred @ basis
        rotation, _ = np.linalg.qr(generator.normal(size=(width, width)))
        for _ in range(iterations):
            u, _, v = np.linalg.svd(np.sign(low @ rotation).T @ low)
            rotation = (u @ v).T
        projections.append(basis @ rotation)
    return Quantiser(mean, np.concatenate(projections, axis=1))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: rows that can link, the vector as bytes of doubles of length 1.

    Left out are null labels, null, empty and zero vectors and those with null or non-finite components.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for row in batch.column("embedding"):
                values = np.array(row.values.to_numpy(zero_copy_only=False), np.float64) if row.is_valid else np.zeros(0)
                # scaled first, so that very long and very short vectors keep their direction
                top = np.abs(values).max() if len(values) and np.isfinite(values).all() else 0.0
                scaled = values / top if top > 0 else values
                out.append((scaled / np.sqrt(scaled @ scaled)).tobytes() if top > 0 else None)
            return pa.record_batch(
                {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "vector": pa.array(out, pa.binary())}
            )

        return step

    kinds = dict(vectors.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, vector binary"
    rows = vectors.filter("label IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "label", "embedding")
    return per_batch(rows, schema, make).filter("vector IS NOT NULL")


def learn(units: DataFrame, sample_rows: int = SAMPLE_ROWS, cosine: float = COSINE) -> dict[int, Quantiser]:
    """A quantiser for each vector length, from the rows with the smallest hash of their id: at most ``sample_rows`` each."""
    found = {}
    lengths = [r[0] for r in units.select(F.length("vector")).distinct().limit(100).collect()]
    for length in lengths:
        drawn = units.filter(F.length("vector") == length).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows)
        rows = [np.frombuffer(r[0], np.float64) for r in drawn.select("vector").toLocalIterator()]
        found[length] = fit_quantiser(np.array(rows), cosine=cosine)
    return found


def coded(units: DataFrame, quantisers: dict[int, Quantiser]) -> DataFrame:
    """Adds ``code`` to distinct vectors ``(label, vector, vec_id, weight)``."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            vectors = batch.column("vector").to_pylist()
            codes = np.zeros(len(vectors), np.uint64)
            for length, quantiser in quantisers.items():
                own = [i for i, v in enumerate(vectors) if len(v) == length]
                if own:
                    codes[own] = quantiser.codes(np.array([np.frombuffer(vectors[i], np.float64) for i in own]))
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(codes.view(np.int64))], names=[*batch.schema.names, "code"]
            )

        return step

    schema = ", ".join(f"{n} {t}" for n, t in units.dtypes)
    return per_batch(units, f"{schema}, code bigint", make)


def at_home(vectors: DataFrame) -> DataFrame:
    """``label, tab, part, vec_id``: every vector under its substring in every table."""
    part = F.expr(f"shiftrightunsigned(code, {PART} * tab) & {2**PART - 1}")
    rows = vectors.select("label", "vec_id", "code", F.explode(F.array(*map(F.lit, range(TABLES)))).alias("tab"))
    return rows.select("label", "tab", part.alias("part"), "vec_id")


def visits(rows: DataFrame) -> DataFrame:
    """The same rows under the smaller substrings near their own."""
    changes = ", ".join(f"{m}L" for m in PROBES)
    others = [c for c in rows.columns if c != "part"]
    changed = rows.select("*", F.explode(F.expr(f"array({changes})")).alias("change"))
    return changed.filter("(part ^ change) < part").selectExpr(*others, "part ^ change AS part").select(*rows.columns)


def bucket_sizes(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``label, tab, part, left_blocks, right_blocks, members`` of the buckets in which vectors meet; ``members`` are those of all its units."""
    homes = at_home(vectors).groupBy("label", "tab", "part").agg(F.count("*").alias("n_home"))
    # buckets visit for their vectors
    coming = visits(homes).groupBy("label", "tab", "part").agg(F.sum("n_home").alias("n_visits"))
    sizes = homes.join(coming, ["label", "tab", "part"], "left")
    sizes = sizes.selectExpr("*", "n_home + coalesce(n_visits, 0) AS n_all").filter("n_all > 1")
    blocks = sizes.select(
        "*",
        F.ceil(F.col("n_home") / block_rows).alias("left_blocks"),
        F.ceil(F.col("n_all") / block_rows).alias("right_blocks"),
    )
    members = "n_home * right_blocks + n_all * left_blocks AS members"
    return blocks.selectExpr("label", "tab", "part", "left_blocks", "right_blocks", members)


@dataclass(frozen=True)
class Rounds:
    """How units of work are dealt to rounds: those of a bucket together, those of the ``wide`` substrings by left block."""

    count: int
    wide: tuple[int, ...] = ()

    @staticmethod
    def of(sizes: DataFrame, most: int) -> Rounds:
        """Rounds of about ``most`` members each."""
        count = -(-(sizes.agg(F.sum("members")).first()[0] or 0) // most) or 1
        # there are at most WIDE_SHARE of them for every round
        wide = sizes.filter(F.col("members") > most // WIDE_SHARE).selectExpr(f"{_SUBSTRING} AS s").distinct()
        return Rounds(count, tuple(r[0] for r in wide.collect()) if count > 1 else ())

    def may_meet(self, n: int) -> str:
        """Condition on ``tab, part``: a unit of round ``n`` may be there."""
        place = f"pmod(xxhash64(tab, part), {self.count}) = {n}"
        return f"{place} OR {_SUBSTRING} IN ({', '.join(map(str, self.wide))})" if self.wide else place

    def meet(self, n: int) -> str:
        """Condition on ``tab, part, left_block``: its units are in round ``n``."""
        spread = f"if({_SUBSTRING} IN ({', '.join(map(str, self.wide))}), left_block, 0L)" if self.wide else "0L"
        return f"pmod(pmod(xxhash64(tab, part), {self.count}) + {spread}, {self.count}) = {n}"


def meetings(vectors: DataFrame, sizes: DataFrame, block_rows: int = BLOCK_ROWS, rounds: Rounds = Rounds(1), n: int = 0) -> DataFrame:
    """``label, tab, part, left_block, right_block, left, home, vec_id``: who meets in which unit of work of round ``n``.

    ``home`` rows of a left block are compared with all rows of a right block.
    """
    homes = at_home(vectors)
    rows = homes.withColumn("home", F.lit(True)).unionByName(visits(homes).withColumn("home", F.lit(False)))
    # most visits find nobody at home
    rows = rows.filter(rounds.may_meet(n)).join(sizes.drop("members").filter(rounds.may_meet(n)), ["label", "tab", "part"])
    left = rows.filter("home").select(
        "label", "tab", "part", "vec_id",
        F.lit(True).alias("left"), F.lit(True).alias("home"),
        block_of(F.col("vec_id"), F.col("left_blocks")).alias("left_block"),
        F.explode(F.expr("sequence(0L, right_blocks - 1)")).alias("right_block"),
    )
    right = rows.select(
        "label", "tab", "part", "vec_id",
        F.lit(False).alias("left"), "home",
        F.explode(F.expr("sequence(0L, left_blocks - 1)")).alias("left_block"),
        block_of(F.col("vec_id"), F.col("right_blocks")).alias("right_block"),
    )
    return left.unionByName(right).filter(rounds.meet(n))


def _first_meeting(a: np.ndarray, b: np.ndarray, tab: int, b_home: np.ndarray, a_ids, b_ids) -> np.ndarray:
    """Which pairs of codes are counted in this table and bucket; ``a`` is at home."""
    mask = np.uint64(2**PART - 1)
    different = a[:, None] ^ b[None, :]
    counted = np.where(b_home[None, :], a_ids[:, None] < b_ids[None, :], True)
    for earlier in range(tab):
        counted &= np.bitwise_count(different >> np.uint64(PART * earlier) & mask) > PROBE_BITS
    return counted


def compare(units: DataFrame, cosine: float) -> DataFrame:
    """``vec_id, n, other``: link counts (``other`` null) and spanning links (``n`` 0) of each unit of work.

    ``units`` has ``tab`` and ``members``, structs of left, home, vec_id, weight, code and vector: two blocks.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: list[np.ndarray] = []
            of: list[np.ndarray] = []
            links: list[tuple[int, int]] = []
            members = batch.column("members")
            bounds = members.offsets.to_numpy()
            rows = members.values
            first = bounds[0]
            rows = rows.slice(first, bounds[-1] - first)
            column = {n: rows.field(n).to_numpy(zero_copy_only=False) for n in ("left", "home", "vec_id", "weight", "code")}
            vectors = rows.field("vector").to_pylist()
            for tab, begin, end in zip(batch.column("tab").to_pylist(), bounds[:-1] - first, bounds[1:] - first):
                own = slice(begin, end)
                left = column["left"][own].astype(bool)
                ids, weight = column["vec_id"][own], column["weight"][own]
                code, home = column["code"][own].view(np.uint64), column["home"][own].astype(bool)
                sizes = np.array([len(v) for v in vectors[own]])
                for size in np.unique(sizes):
                    a, b = left & (sizes == size), ~left & (sizes == size)
                    if not a.any() or not b.any():
                        continue
                    picked = [vectors[own][i] for i in np.flatnonzero(a)], [vectors[own][i] for i in np.flatnonzero(b)]
                    x, y = (np.frombuffer(b"".join(p), np.float64).reshape(len(p), -1) for p in picked)
                    linked = (x @ y.T >= cosine) & _first_meeting(code[a], code[b], tab, home[b], ids[a], ids[b])
                    if linked.any():
                        of += [ids[a], ids[b]]
                        counts += [linked @ weight[b], weight[a] @ linked]
                        links += spanning_links(linked, ids[a], ids[b])
            ids = np.concatenate(of) if of else np.zeros(0, np.int64)
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            some = n > 0
            u, v = (np.array(c, np.int64) for c in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
            other = pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(v)])
            return pa.record_batch(
                {
                    "vec_id": pa.array(np.concatenate([ids[some], u])),
                    "n": pa.array(np.concatenate([n[some], np.zeros(len(u), np.int64)])),
                    "other": other,
                }
            )

        return step

    return per_batch(units, "vec_id bigint, n bigint, other bigint", make)


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``.

    Rows link when their labels are equal and not null and the cosine of their vectors, in double precision, is at least
    ``cosine``. Vectors that are null, empty or zero or hold null or non-finite components, rows without a label and vectors of
    different lengths do not link. ``component_id`` is the smallest id reachable, ``kept`` whether it is the row's own. Equal
    vectors link, those of a repeated id too; its rows all get the most links and the smallest component found. A null id
    has a null component. Other columns are ignored; an empty table gives no rows.
    """
    configure(vectors.sparkSession)
    digest = F.unhex(F.sha2("vector", 256))
    units = written(unit_vectors(vectors).withColumn("digest", digest), "units")
    distinct = units.groupBy("label", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    distinct = written(coded(distinct, learn(units, cosine=cosine)), "codes")

    sizes = written(bucket_sizes(distinct, block_rows), "bucket-sizes")
    length = distinct.agg(F.max(F.length("vector"))).first()[0] or 0
    rounds = Rounds.of(sizes, max(1, round_bytes // (length + MEMBER_BYTES)))

    def links(n: int) -> DataFrame:
        joined = meetings(distinct, sizes, block_rows, rounds, n).join(distinct.select("vec_id", "weight", "code", "vector"), "vec_id")
        # two blocks at most meet in a unit, so its list is bounded
        work = joined.groupBy("label", "tab", "part", "left_block", "right_block").agg(
            F.collect_list(F.struct("left", "home", "vec_id", "weight", "code", "vector")).alias("members")
        )
        return compare(work.filter("size(members) > 1").select("tab", "members"), cosine)

    found = written_in_turn((links(n) for n in range(rounds.count)), "links")
    counts = found.filter("other IS NULL").groupBy("vec_id").agg(F.sum("n").alias("n"))
    components = smallest_reachable(found.filter("other IS NOT NULL").selectExpr("vec_id AS a", "other AS b"))

    of_vector = (
        distinct.join(counts, "vec_id", "left")
        .join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "label",
            digest.alias("digest"),
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component"),
        )
    )
    of_row = units.drop("vector").join(of_vector, ["label", "digest"]).groupBy("vec_id")
    of_row = of_row.agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    return (
        vectors.select("vec_id")
        .join(of_row, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )
