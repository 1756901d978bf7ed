import gzip
import random
import tracemalloc

import pyarrow as pa
import pytest

from fleetgauge.sources import codec_ranges as R
from fleetgauge.sources.event_logs import scan_event_log_codec


def frame(data, codec):
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, codec) as stream:
        stream.write(data)
    return sink.getvalue().to_pybytes()


def text(seed, lines=400):
    draw = random.Random(seed)
    return b"\n".join(bytes(draw.choices(b"abc {}\r\xc3\xa9", k=draw.choice([0, 3, 80, 2000]))) for _ in range(lines))


def cut(data, draw, pieces):
    at = sorted(draw.randrange(len(data) + 1) for _ in range(pieces - 1))
    return [data[a:b] for a, b in zip([0, *at], [*at, len(data)])]


def plain(data):
    parts = [line.decode("utf-8", "replace").rstrip("\r") for line in data.split(b"\n")]
    return parts[:-1] if data.endswith(b"\n") or not data else parts


@pytest.mark.parametrize("codec", ["lz4", "zstd"])
@pytest.mark.parametrize("ending", [b"", b"\n"])
def test_ranges_give_each_line_once(tmp_path, codec, ending):
    draw = random.Random(codec + str(ending))
    data = text(codec) + ending
    skipped = (R.SKIPPED_FRAME + 3).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"aside"
    path = tmp_path / f"log.{codec}"
    path.write_bytes(skipped + b"".join(frame(p, codec) for p in cut(data, draw, 30)) + skipped)
    size = path.stat().st_size
    with pa.OSFile(str(path)) as file:
        assert [a for a, _ in R.frames(file)][1:] == [b for _, b in R.frames(file)][:-1]
        for step in (size + 1, size // 2, size // 7, 100):
            lines = [
                line.decode("utf-8", "replace").rstrip("\r")
                for start in range(0, size, step)
                for line in R.range_lines(file, R.ByteRange("", codec, start, min(start + step, size)))
            ]
            assert lines == plain(data)


def test_the_source_agrees_with_the_whole_file_reader(spark, tmp_path):
    data = text("all") + b"\n"
    draw = random.Random(5)
    folder = tmp_path / "logs with blanks"
    folder.mkdir()
    (folder / "a.lz4").write_bytes(b"".join(frame(p, "lz4") for p in cut(data, draw, 9)))
    (folder / "b.ZST").write_bytes(b"".join(frame(p, "zstd") for p in cut(data, draw, 9)))
    (folder / "c.gz.old").write_bytes(gzip.compress(data[:5000]) + gzip.compress(data[5000:]))
    (folder / "d.snappy").write_bytes(pa.compress(data, codec="snappy", asbytes=True))
    (folder / "empty.lz4").write_bytes(b"")
    (folder / "_SUCCESS.lz4").write_bytes(b"junk")  # hidden from Spark's readers too
    (folder / "plain.txt").write_bytes(b"not here\n")
    ours = R.scan_codec_ranges(spark, f"file://{tmp_path}", range_bytes=700)
    assert ours.columns == ["log_path", "ord_block", "value", "error"] and ours.rdd.getNumPartitions() > 20
    by_name = {}
    got = ours.collect()
    for row in got:
        by_name.setdefault(row.log_path.rsplit("/", 1)[-1], []).append((row.ord_block, row.value))
    assert {n: [v for _, v in rows] for n, rows in by_name.items()} == {n: plain(data) for n in ("a.lz4", "b.ZST", "c.gz.old", "d.snappy")}
    assert all([b for b, _ in rows] == sorted(b for b, _ in rows) for rows in by_name.values())
    (folder / "empty.lz4").unlink()
    theirs = scan_event_log_codec(spark.read, str(tmp_path)).select("log_path", "value").filter("log_path NOT LIKE '%SUCCESS%'").collect()
    assert sorted(map(tuple, theirs)) == sorted((r.log_path, r.value) for r in got)


@pytest.mark.parametrize("codec", ["lz4", "zstd"])
def test_a_frame_is_decoded_in_bounded_memory(tmp_path, codec):
    path = tmp_path / f"log.{codec}"
    line = b"x" * 999 + b"\n"
    path.write_bytes(frame(line * 200_000, codec))  # 200 MB of text in one frame
    with pa.OSFile(str(path)) as file:
        tracemalloc.start()
        n = sum(1 for _ in R.range_lines(file, R.ByteRange("", codec, 0, file.size())))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert n == 200_000 and peak < 16 << 20


@pytest.mark.parametrize("content", [b"nonsense", frame(b"a\n" * 9000, "lz4")[:-9], frame(b"a\n" * 9000, "zstd")[:-5]])
def test_damaged_frames_are_told(tmp_path, content):
    path = tmp_path / "log.lz4"
    path.write_bytes(content)
    with pa.OSFile(str(path)) as file, pytest.raises((EOFError, ValueError, OSError)):
        list(R.range_lines(file, R.ByteRange("", "lz4", 0, len(content))))


def test_small_files_share_tasks(spark, tmp_path):
    for n in range(300):
        folder = tmp_path / f"log_id={n}"
        folder.mkdir()
        data = b"".join(frame(f"{n} {i}\n".encode() * 40, "lz4") for i in range(3))
        (folder / "0.lz4").write_bytes(data)
    read = R.scan_codec_ranges(spark, str(tmp_path), range_bytes=60)
    assert read.rdd.getNumPartitions() <= 2 * R.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert sorted(r.value for r in read.collect()) == sorted(f"{n} {i}" for n in range(300) for i in range(3) for _ in range(40))


def test_groups_keep_every_range_once_and_their_bound():
    sizes = [(i * 37) % 50 << 20 for i in range(200)] + [R.RANGE_BYTES]
    ranges = [R.ByteRange(f"f{i}", "lz4", 0, size) for i, size in enumerate(sizes)]
    groups = R.grouped(ranges, 4)
    assert [r for g in groups for r in g.ranges] == ranges
    assert all(len(g.ranges) == 1 or sum(r.stop + R.OPEN_BYTES for r in g.ranges) <= R.RANGE_BYTES for g in groups)
    assert R.grouped([], 4) == []
