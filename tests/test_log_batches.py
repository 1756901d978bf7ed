"""Short log files share batches, on their way in and out."""

import pyarrow as pa

from fleetgauge.sources.event_logs import LINES_PER_BATCH, _decoder
from workload.catalog import _compress

TEXTS = [(f"/logs/log_id=a{i}/{i % 4}.{('lz4', 'snappy')[i % 2]}", [f"line {i} {n}" for n in range(1 + i % 5)]) for i in range(200)]


def batches_of(rows, size):
    for start in range(0, len(rows), size):
        paths, values = zip(*rows[start : start + size])
        yield pa.record_batch({"path": pa.array(paths, pa.string()), "value": pa.array(values, pa.string())})


def test_files_share_batches_and_keep_their_lines():
    rows = [(path, line) for path, lines in TEXTS for line in lines]
    # batches of three rows cut most files
    files = pa.Table.from_batches(_compress(batches_of(rows, 3)))
    assert files["path"].to_pylist() == [path for path, _ in TEXTS]
    read = list(_decoder(False)(files.combine_chunks().to_batches()))
    assert len(read) == 1
    table = pa.Table.from_batches(read)
    assert list(zip(table["log_path"].to_pylist(), table["value"].to_pylist())) == rows
    assert table["error"].null_count == len(rows)


def test_a_batch_holds_a_bounded_number_of_lines():
    rows = [("/logs/log_id=a/0.lz4", f"line {n}") for n in range(2 * LINES_PER_BATCH + 5)]
    files = pa.Table.from_batches(_compress(batches_of(rows, 7_000)))
    read = list(_decoder(False)(files.to_batches()))
    assert [b.num_rows for b in read] == [LINES_PER_BATCH, LINES_PER_BATCH, 5]
    assert [v for b in read for v in b.column("value").to_pylist()] == [line for _, line in rows]


def test_damaged_files_stand_between_others():
    files = pa.Table.from_batches(_compress(batches_of([("/logs/a.lz4", "one"), ("/logs/c.lz4", "two")], 2)))
    damaged = pa.record_batch({"path": ["/logs/b.lz4"], "content": pa.array([b"no frame"], pa.binary())})
    whole = files.combine_chunks().to_batches()
    read = pa.Table.from_batches(_decoder(True)([whole[-1].slice(0, 1), damaged, whole[-1].slice(1, 1)]))
    assert read["value"].to_pylist() == ["one", None, "two"]
    assert [e is not None for e in read["error"].to_pylist()] == [False, True, False]
