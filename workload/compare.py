"""Runs catalogue queries next to their SQL and compares rows, column names and values.

    python -m workload.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from workload import catalog

TABLES = (
    *("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"),
    *("documents", "embeddings", "pages", "benchmark", "labels", "conversations"),
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float) and value == int(value) and abs(value) < 2**53:
        return int(value)
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark: SparkSession, connection, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in catalog.ORACLES:
        return None
    cursor = connection.execute(catalog.ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(theirs):
        return f"columns {sorted(df.columns)} against {sorted(theirs)}"
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    wide = [c for c, kind in kinds.items() if kind in ("HUGEINT", "DECIMAL") or kind.startswith("DECIMAL")]
    if wide:
        return f"oracle columns of a type Spark lacks: {wide}"
    ours, expected = _bag(df.columns, rows), _bag(theirs, cursor.fetchall())
    if ours != expected:
        only_ours, only_theirs = list((ours - expected).items()), list((expected - ours).items())
        return (
            f"{len(rows)} rows, {sum(expected.values())} expected, {len(only_ours)} differ;"
            f" columns {sorted(df.columns)}\n  ours   {only_ours[:2]}\n  theirs {only_theirs[:2]}"
        )
    return None if rows else "no rows"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            problem = difference(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - started:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
