"""Compressed logs read by byte range: a Spark data source for files of any size.

LZ4 and Zstandard files are sequences of frames, and event logs have many. A task reads byte ranges of files, many where they are small.
A range owns the frames that start in it; it finds them by hopping over block headers, without decoding what it skips. Lines reach over frames:
a range that is not the first leaves out everything up to its first line feed, and every range reads on
until the line it has begun ends. Gzip is one range, decoded as a stream. Only the chunk being decoded and one line are held.
A raw Snappy file is a single block of at most 4 GiB and is the one kind that is decoded whole.

Files are opened through Arrow's file systems (local, object stores, HDFS where its client library is installed). For other stores,
:func:`fleetgauge.sources.event_logs.scan_event_log_codec` reads files of up to 2 GiB through Spark.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fleetgauge.sources.event_logs import BLOCK_NAME, GZIP_NAME, LINES_SCHEMA, ZSTD_NAME, _snappy_length

SOURCE = "codec_ranges"
RANGE_BYTES = 128 << 20
CHUNK_BYTES = 1 << 20
LINES_PER_BATCH = 10_000
# What opening a range counts for when ranges are dealt to tasks, in bytes.
OPEN_BYTES = 256 << 10
TASKS_PER_CORE = 4
# Fixed values of both frame formats: little-endian marks at the start of a frame, and of one to skip.
LZ4_FRAME, ZSTD_FRAME, SKIPPED_FRAME = 0x184D2204, 0xFD2FB528, 0x184D2A50
# Characters that stand for themselves in the URI of a file, as Spark writes it.
PLAIN = "/!$&'()*+,;=:@~"


@dataclass
class ByteRange(InputPartition):
    path: str
    kind: str
    start: int
    stop: int


@dataclass
class RangeGroup(InputPartition):
    """Ranges that one task reads one after another."""

    ranges: list[ByteRange]


def grouped(ranges: list[ByteRange], tasks: int) -> list[RangeGroup]:
    """Ranges in their order, dealt to tasks of at most ``RANGE_BYTES`` or one range; with little to read, evenly to ``tasks``."""
    costs = [part.stop - part.start + OPEN_BYTES for part in ranges]
    most = min(RANGE_BYTES, -(-sum(costs) // max(tasks, 1)))
    groups: list[RangeGroup] = []
    held = 0
    for part, cost in zip(ranges, costs):
        if not groups or held + cost > most:
            groups.append(RangeGroup([]))
            held = 0
        groups[-1].ranges.append(part)
        held += cost
    return groups


def kind_of(path: str) -> str | None:
    """The codec that a file's name stands for, None for files that are not compressed."""
    name = path.rsplit("/", 1)[-1]
    if re.search(GZIP_NAME, name):
        return "gzip"
    block = re.search(BLOCK_NAME, name)
    if block:
        return block[1].lower()
    return "zstd" if re.search(ZSTD_NAME, name) else None


def _number(file: pa.NativeFile, at: int, size: int) -> int:
    file.seek(at)
    read = file.read(size)
    if len(read) < size:
        raise EOFError(f"a frame ends in the middle, at byte {at + len(read)}")
    return int.from_bytes(read, "little")


def _lz4_end(file: pa.NativeFile, at: int) -> int:
    flags = _number(file, at + 4, 1)
    sums, sized, whole_sum, dictionary = flags >> 4 & 1, flags >> 3 & 1, flags >> 2 & 1, flags & 1
    at += 7 + 8 * sized + 4 * dictionary
    while size := _number(file, at, 4):
        at += 4 + (size & 0x7FFFFFFF) + 4 * sums
    return at + 4 + 4 * whole_sum


def _zstd_end(file: pa.NativeFile, at: int) -> int:
    flags = _number(file, at + 4, 1)
    single, whole_sum = flags >> 5 & 1, flags >> 2 & 1
    content = {0: single, 1: 2, 2: 4, 3: 8}[flags >> 6]
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
    last = 0
    while not last:
        header = _number(file, at, 3)
        last, repeated, size = header & 1, header >> 1 & 3 == 1, header >> 3
        at += 3 + (1 if repeated else size)
    return at + 4 * whole_sum


def frames(file: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """Start and end of every frame that holds data, found by its headers."""
    at, size = 0, file.size()
    while at < size:
        mark = _number(file, at, 4)
        if mark & 0xFFFFFFF0 == SKIPPED_FRAME:
            at += 8 + _number(file, at + 4, 4)
            continue
        if mark not in (LZ4_FRAME, ZSTD_FRAME):
            raise ValueError(f"no frame at byte {at}")
        end = (_lz4_end if mark == LZ4_FRAME else _zstd_end)(file, at)
        yield at, end
        at = end


class Slice:
    """A part of an open file, as a file of its own."""

    closed = False

    def __init__(self, file: pa.NativeFile, start: int, stop: int):
        self.file, self.at, self.stop = file, start, stop

    def read(self, size: int = -1) -> bytes:
        left = self.stop - self.at
        self.file.seek(self.at)
        read = self.file.read(left if size < 0 else min(size, left))
        self.at += len(read)
        return read

    def close(self) -> None:
        self.closed = True


def decoded(file: pa.NativeFile, kind: str, start: int, end: int) -> Iterator[bytes]:
    """The content of one frame, or of a whole file, in chunks."""
    if kind == "snappy":
        block = memoryview(Slice(file, start, end).read())
        yield pa.decompress(block, _snappy_length(block), codec="snappy", asbytes=True)
        return
    part = Slice(file, start, end)
    stream = gzip.GzipFile(fileobj=part) if kind == "gzip" else pa.CompressedInputStream(pa.PythonFile(part, "r"), kind)
    while chunk := stream.read(CHUNK_BYTES):
        yield chunk


def range_content(file: pa.NativeFile, part: ByteRange) -> Iterator[tuple[bytes, bool]]:
    """Chunks from the first frame of a range on, each with whether a frame of the range gave it."""
    if part.kind in ("gzip", "snappy"):
        if file.size():
            yield from ((chunk, True) for chunk in decoded(file, part.kind, 0, file.size()))
        return
    for start, end in frames(file):
        if start >= part.start:
            yield from ((chunk, start < part.stop) for chunk in decoded(file, part.kind, start, end))


def range_lines(file: pa.NativeFile, part: ByteRange) -> Iterator[bytes]:
    """The lines that begin in the frames of a range, after the first of them unless the range begins the file."""
    rest: list[bytes] = []
    begun = part.start == 0
    for chunk, own in range_content(file, part):
        if not own and not begun:
            return  # no line begins in this range
        if not own:
            end = chunk.find(b"\n")
            rest.append(chunk if end < 0 else chunk[:end])
            if end >= 0:
                yield b"".join(rest)
                return
            continue
        if not begun:
            end = chunk.find(b"\n")
            if end < 0:
                continue
            begun, chunk = True, chunk[end + 1 :]
        *whole, last = chunk.split(b"\n")
        for line in whole:
            yield b"".join([*rest, line])
            rest = []
        rest.append(last)
    if begun and any(rest):
        yield b"".join(rest)


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system a path or URI is in, its path there, and what stands before it in the URIs of its files."""
    scheme, mark, rest = path.partition("://")
    if not mark or scheme == "file":
        return fs.LocalFileSystem(), unquote(rest) if mark else path.removeprefix("file:"), "file:"
    store, root = fs.FileSystem.from_uri(path)
    return store, root, f"{scheme}://{urlsplit(path).netloc if root.startswith('/') else ''}"


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tasks = int(options.get("tasks", 1))

    def partitions(self) -> list[RangeGroup]:
        return grouped(self.ranges(), self.tasks)

    def ranges(self) -> list[ByteRange]:
        """Ranges of the compressed files below the path; names and sizes are listed, nothing is opened."""
        store, root, _ = opened(self.path)
        found = store.get_file_info(root)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        parts = []
        for file in sorted((f for f in files if f.is_file), key=lambda f: f.path):
            kind = kind_of(file.path)
            hidden = any(name.startswith(("_", ".")) for name in file.path[len(root) :].split("/"))
            if kind and not hidden:
                step = file.size + 1 if kind in ("gzip", "snappy") else self.range_bytes
                starts = range(0, max(file.size, 1), step)
                parts += [ByteRange(file.path, kind, at, min(at + step, file.size)) for at in starts]
        return parts

    def read(self, partition: RangeGroup) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from self.read_range(part)

    def read_range(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        store, _, before = opened(self.path)
        shown = before + quote(partition.path, safe=PLAIN)

        def batch(lines: list[str]) -> pa.RecordBatch:
            columns = [[shown] * len(lines), [partition.start] * len(lines), lines, [None] * len(lines)]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, ["log_path", "ord_block", "value", "error"])

        with store.open_input_file(partition.path) as file:
            held: list[str] = []
            for line in range_lines(file, partition):
                # malformed bytes are replaced, as the text reader does
                held.append(line.decode("utf-8", "replace").rstrip("\r"))
                if len(held) == LINES_PER_BATCH:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)


class CodecRanges(DataSource):
    """``log_path, ord_block, value, error`` of every compressed file below ``path``; ``ord_block`` is the range's first byte."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return LINES_SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def scan_codec_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of every compressed log below ``path``, split by frames. A damaged file fails the query."""
    spark.dataSource.register(CodecRanges)
    tasks = str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return spark.read.format(SOURCE).option("path", path).option("rangeBytes", str(range_bytes)).option("tasks", tasks).load()
