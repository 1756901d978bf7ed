"""Logs of larger tables are written, read and deleted round by round."""

import pytest

from workload import adapters, catalog

QUERIES = (
    *("scan_event_log", "scan_codec_ranges", "list_event_logs", "parse_events", "filter_event_types", "stage_facts", "task_measures"),
    *("job_metrics", "stream_event_logs"),
)


def save_tables(spark, folder, nulls=False):
    """Tasks of 40 orders in each of three logs of four applications, one row twice."""
    rows = spark.range(120).selectExpr(
        "id % 3 * 200000 + id AS l_orderkey",
        f"if({str(nulls).lower()} AND id % 10 = 1, NULL, 1 + id % 4) AS l_suppkey",
        "id AS l_partkey",
        "int(1 + id % 7) AS l_linenumber",
        "double(1 + id % 50) AS l_quantity",
        "double(900 + id) AS l_extendedprice",
        "0.05D AS l_discount",
        "0.02D AS l_tax",
        "CASE id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS l_returnflag",
    )
    rows.unionByName(rows.filter("l_partkey = 5")).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(1, 5).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name").write.parquet(f"{folder}/supplier.parquet")
    return f"{folder}"


def rows_of(df):
    return sorted(map(str, df.collect()))


# without null keys, rounds of less than a log number; with them, rounds of one log number and one of the logs without a name
@pytest.mark.parametrize(("nulls", "names", "most"), [(False, ["scan_event_log_codec"], 25), (True, QUERIES, 45)])
def test_rounds_give_the_rows_of_one_round(spark, tmp_path, monkeypatch, nulls, names, most):
    whole, dealt = (save_tables(spark, tmp_path / name, nulls) for name in ("whole", "dealt"))
    expected = {name: rows_of(catalog.QUERIES[name](spark, whole)) for name in names}
    monkeypatch.setattr(adapters, "TASKS_PER_ROUND", most)
    assert len(adapters.log_rounds(spark, dealt)) >= 4
    for name in names:
        assert rows_of(catalog.QUERIES[name](spark, dealt)) == expected[name], name


def test_only_one_round_lies_on_the_disk(spark, tmp_path, monkeypatch):
    sf = save_tables(spark, tmp_path / "tables", nulls=True)
    root = tmp_path / "staged"
    monkeypatch.setattr(adapters, "new_path", lambda spark, name: f"file://{root}/{name}")
    monkeypatch.setattr(adapters, "TASKS_PER_ROUND", 25)
    ids = {r[0] for r in adapters.log_lines(spark, sf).select("log_id").distinct().collect()}
    seen = []
    for _, lines in adapters.log_folders(spark, sf):
        of_round = {str(r[0] or "__HIVE_DEFAULT_PARTITION__") for r in lines.select("log_id").distinct().collect()}
        assert {f.parent.name.removeprefix("log_id=") for f in root.glob("logs/**/part-*") if f.is_file()} == of_round
        seen += of_round
    assert None in ids and sorted(seen) == sorted(str(i or "__HIVE_DEFAULT_PARTITION__") for i in ids)
    assert not [f for f in root.glob("logs/**/*") if f.is_file()]


def test_rounds_hold_whole_logs_up_to_a_number_of_tasks():
    conditions = adapters.round_conditions([(None, 7), (0, 4), (1, 5), (3, 2), (4, 21), (6, 3)], 10)
    assert conditions == [
        "log_id IS NULL",
        "log_no BETWEEN 0 AND 1 AND log_id IS NOT NULL",
        "log_no BETWEEN 3 AND 3 AND log_id IS NOT NULL",
        *[f"log_no = 4 AND pmod(xxhash64(log_id), 3) = {i} AND log_id IS NOT NULL" for i in range(3)],
        "log_no BETWEEN 6 AND 6 AND log_id IS NOT NULL",
    ]
    assert adapters.round_conditions([], 10) == adapters.round_conditions([(None, 4), (0, 6)], 10) == ["true"]
