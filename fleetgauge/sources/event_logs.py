"""Event-log sources.

Every reader yields the same four columns: ``log_path`` (one log is one application), ``value``
(one JSON line), and ``ord_block``/``ord_row``, which together increase in file order.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that mean gzip anywhere among the suffixes, and the last-suffix codecs.
GZIP_NAME = r"(?i)\.gz(\.|$)"
BLOCK_NAME = r"(?i)\.(lz4|snappy)$"
ZSTD_NAME = r"(?i)\.zstd?$"
LINE_COLUMNS = ("log_path", "ord_block", "ord_row", "value")
LINES_SCHEMA = "log_path string, ord_block bigint, value string, error string"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
LINES_PER_BATCH = 10_000
CHECKED_BYTES = 1 << 20
# What the decoders raise for a damaged file.
DAMAGED = (OSError, EOFError, ValueError, MemoryError, zlib.error, pa.ArrowException)


def needs_decoding(name: Column) -> Column:
    """True for files Hadoop's text reader would not decode: LZ4 frames, raw Snappy blocks, gzip whose
    ``.gz`` is not the last suffix, and upper-case suffixes."""
    hadoop_gzip = name.endswith(".gz")
    hadoop_zstd = name.endswith(".zst") | name.endswith(".zstd")
    gzip_name = name.rlike(GZIP_NAME)
    return (
        (gzip_name & ~hadoop_gzip)
        | (~gzip_name & name.rlike(BLOCK_NAME))
        | (~gzip_name & name.rlike(ZSTD_NAME) & ~hadoop_zstd)
    )


def is_compressed(name: Column) -> Column:
    """True for every compressed file, whoever can decode it."""
    return name.rlike(GZIP_NAME) | name.rlike(BLOCK_NAME) | name.rlike(ZSTD_NAME)


def list_event_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per file under ``path``: path, name, size, modified_at. File contents are not read.

    ``path`` is the ``log_path`` of the scans: the file's URI, blanks and the like escaped. ``name`` is not escaped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    ).filter(F.col("name") != "")


def scan_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all logs under ``path``, whatever their compression.

    Plain, ``.gz``, ``.zst`` and ``.zstd`` files go through the text reader, which splits plain files;
    the others are decoded by :func:`scan_event_log_codec`.
    """
    return number_rows(scan_lines(spark.read, path))


def scan_lines(reader, path: str, isolate: bool = False) -> DataFrame:
    """Lines of all logs, not numbered yet. ``reader`` is ``spark.read`` or ``spark.readStream``.

    A damaged file fails the query. With ``isolate`` it gives one row with an ``error`` and no line instead: all
    compressed files are then decoded here, each read through once before its lines leave.
    """
    return scan_text_logs(reader, path, isolate).unionByName(scan_event_log_codec(reader, path, isolate))


def readable_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("error IS NULL")


def failed_logs(lines: DataFrame) -> DataFrame:
    """``log_path, error`` of the damaged files of an isolating scan."""
    return lines.filter("error IS NOT NULL").select("log_path", "error")


def scan_text_logs(reader, path: str, isolate: bool = False) -> DataFrame:
    """Logs Hadoop can decode; with ``isolate`` only those that need no decoding."""
    elsewhere = is_compressed if isolate else needs_decoding
    lines = reader.format("text").schema("value string").option("recursiveFileLookup", "true").load(path)
    # a metadata filter prunes whole files from the listing
    readable = lines.filter(~elsewhere(F.col("_metadata.file_name")))
    return readable.select(
        F.col("_metadata.file_path").alias("log_path"),
        F.col("_metadata.file_block_start").alias("ord_block"),
        "value",
        F.lit(None).cast("string").alias("error"),
    )


def scan_event_log_codec(reader, path: str, isolate: bool = False) -> DataFrame:
    """Logs that need decoding outside Hadoop's codecs, with ``isolate`` all compressed ones; no other file is opened."""
    chosen_here = is_compressed if isolate else needs_decoding
    files = reader.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(path)
    chosen = files.filter(chosen_here(F.col("_metadata.file_name")))
    return decode_logs(chosen.select(F.col("_metadata.file_path").alias("path"), "content"), isolate)


def number_rows(lines: DataFrame) -> DataFrame:
    """Adds ``ord_row``, which grows with the position inside a file split. Must directly follow the scan."""
    return lines.withColumn("ord_row", F.monotonically_increasing_id()).select(*LINE_COLUMNS)


def decode_logs(files: DataFrame, isolate: bool = False) -> DataFrame:
    """Lines of compressed files given as (path, content), in file order.

    These formats cannot be split, so one file is decoded by one task; frames are decoded as a
    stream and lines leave in batches.
    """
    return files.select("path", "content").mapInArrow(_decoder(isolate), LINES_SCHEMA)


def _open_stream(path: str, content: memoryview) -> io.BufferedIOBase:
    name = path.rsplit("/", 1)[-1].lower()
    suffix = name.rsplit(".", 1)[-1]
    if re.search(GZIP_NAME, name):
        return gzip.GzipFile(fileobj=io.BytesIO(content))
    if suffix == "snappy":
        return io.BytesIO(pa.decompress(content, _snappy_length(content), codec="snappy", asbytes=True))
    return pa.CompressedInputStream(pa.py_buffer(content), "lz4" if suffix == "lz4" else "zstd")


def _snappy_length(content: memoryview) -> int:
    """A raw Snappy block starts with its decoded length, seven bits per byte, low bits first."""
    length = 0
    for position, byte in enumerate(content[:5]):
        length |= (byte & 0x7F) << (7 * position)
        if byte < 0x80:
            break
    return length


def _damage(path: str, content: memoryview) -> str | None:
    """What is wrong with a file, found by decoding all of it without keeping it."""
    try:
        stream = _open_stream(path, content)
        while stream.read(CHECKED_BYTES):
            pass
    except DAMAGED as error:
        return f"{type(error).__name__}: {error}"
    return None


def _rows(paths: list[str], values: list[str | None], errors: list[str | None]) -> pa.RecordBatch:
    columns = [
        pa.array(paths, pa.string()),
        pa.array([0] * len(paths), pa.int64()),
        pa.array(values, pa.string()),
        pa.array(errors, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["log_path", "ord_block", "value", "error"])


def _decoder(isolate: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch costs far more than a short file does, so files share them
        paths: list[str] = []
        values: list[str | None] = []
        errors: list[str | None] = []
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = memoryview(content.as_buffer()).cast("B")
                damage = _damage(path, view) if isolate else None
                if damage is not None:
                    found = iter([None])
                else:
                    # malformed bytes are replaced, as the text reader does
                    lines = io.TextIOWrapper(_open_stream(path, view), encoding="utf-8", errors="replace", newline="\n")
                    found = (line.rstrip("\r\n") for line in lines)
                while chunk := [line for _, line in zip(range(LINES_PER_BATCH - len(paths)), found)]:
                    values += chunk
                    paths += [path] * len(chunk)
                    errors += [damage] * len(chunk)
                    if len(paths) == LINES_PER_BATCH:
                        yield _rows(paths, values, errors)
                        paths, values, errors = [], [], []
        yield _rows(paths, values, errors)

    return decode
