"""Running a workload query in Spark and its SQL in DuckDB, side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    """Rows with columns by name, in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(round(value, 12)))
    return value


def difference(spark_df, con, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    expected = rows_of(names, result.fetchall())
    actual = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(actual) != len(expected):
        only_spark = [r for r in actual if r not in expected][:2] if len(actual) < 5000 else []
        only_sql = [r for r in expected if r not in actual][:2] if len(actual) < 5000 else []
        return f"{len(actual)} rows != {len(expected)}; spark only {only_spark}; sql only {only_sql}"
    for a, e in zip(actual, expected):
        if a != e:
            return f"row {a} != {e}"
    return None
