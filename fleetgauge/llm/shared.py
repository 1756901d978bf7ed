"""What the operators share: session settings, the shared folder, written tables, components of a link graph."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.session import shuffles_dropped

# Rows per Arrow batch: texts may be long, so a batch of rows stays small.
BATCH_ROWS = 1000

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the library's modules to the executors, once per application: their Python workers import them."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "fleetgauge.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators are written for; adaptive execution splits skewed joins."""
    ship_package(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one (as in tests) gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fleetgauge-llm-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_in_turn(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """As :func:`written`, for several tables of the same columns, one after the other; there is at least one."""
    path = None
    for df in parts:
        path = path or f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
        with shuffles_dropped(df.sparkSession):
            df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a table made by :func:`written`, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]
) -> DataFrame:
    """Runs ``make()`` once per task and the function it returns on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def word_chunks(text: str, pattern: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of ``pattern`` in the UTF-8 bytes of ``text`` with A-Z lower-cased, a list for about every ``size`` bytes.

    ``pattern`` is a set of bytes, repeated. Pieces end where a run ends, so none is cut.
    """
    data = text.encode()
    find = re.compile(pattern)
    inside = re.compile(pattern.removesuffix(b"+") + b"*")
    at = 0
    while at < len(data):
        # lower-casing may make a byte fit the pattern, so it comes first
        stop = at + size
        piece = data[at:stop].lower()
        while stop < len(data) and inside.match(more := data[stop : stop + size].lower()).end():
            end = inside.match(more).end()
            piece += more[:end]
            stop += end
            if end < len(more):
                break
        yield find.findall(piece)
        at = stop


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the smallest node reachable.

    Alternates two steps until nothing changes: each node's larger neighbours, then its smaller ones, are
    linked to the smallest node among them. Rounds grow with the logarithm of the number of nodes. Minima
    are combined before the shuffle and a hub's links are split by the skew join, so no node's links meet
    in one task. Links with a null end are ignored; no links give no rows.
    """
    edges = links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u > v").distinct()
    edges = written(edges, "links")
    known = _fingerprint(edges)
    while True:
        both = edges.union(edges.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("v0")).selectExpr("u", "least(u, v0) AS m")
        larger = both.filter("v > u").join(low, "u").selectExpr("v AS u", "m AS v")
        larger = larger.filter("u > v").distinct()
        low = larger.groupBy("u").agg(F.min("v").alias("m"))
        moved = larger.join(low, "u").filter("v > m").selectExpr("v AS u", "m AS v")
        after = written(moved.union(low.selectExpr("u", "m AS v")).distinct(), "links")
        now = _fingerprint(after)
        drop_written(edges)
        edges = after
        if now == known:
            break
        known = now
    roots = edges.selectExpr("v AS node", "v AS component").distinct()
    return edges.selectExpr("u AS node", "v AS component").union(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def block_of(key: Column, blocks: Column) -> Column:
    """Which of ``blocks`` parts a row falls in, by the hash of ``key``."""
    return F.pmod(F.xxhash64(key), blocks)


def hash_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Which leading ``bits`` bits the hashes in the one column of ``keys`` have: 2^bits flags, whatever the keys."""
    name = keys.columns[0]
    rows = (
        keys.filter(F.col(name).isNotNull())
        .select(F.expr(f"shiftrightunsigned({name}, {64 - bits})").alias("bit"))
        .selectExpr("bit DIV 64 AS word", "shiftleft(1L, int(bit % 64)) AS mask")
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
    )
    words = np.zeros(1 << (bits - 6), np.int64)
    for row in rows.toLocalIterator():
        words[row["word"]] = row["mask"]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def leading_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The place of each signed 64-bit hash in a bitmap of 2^bits flags."""
    return hashes.astype(np.int64, copy=False).view(np.uint64) >> np.uint64(64 - bits)


def spanning_links(linked: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the linked pairs connect, fewer than there are vectors."""
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    inner = linked[np.ix_(rows, columns)]
    left, right = a_ids[rows], b_ids[columns]
    low_left, low_right = left.copy(), right.copy()
    big = np.iinfo(np.int64).max
    while True:
        new_right = np.minimum(low_right, np.where(inner, low_left[:, None], big).min(axis=0))
        new_left = np.minimum(low_left, np.where(inner, new_right[None, :], big).min(axis=1))
        if (new_left == low_left).all() and (new_right == low_right).all():
            break
        low_left, low_right = new_left, new_right
    return [(int(x), int(y)) for x, y in zip(np.append(left, right), np.append(low_left, low_right)) if x != y]
