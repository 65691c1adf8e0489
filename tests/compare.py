"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if value == 0:
        return type(value)(0)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """What differs, or None."""
    names, found = _sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    wanted_names, wanted = _sorted_rows(columns, result.fetchall())
    if names != wanted_names:
        return f"columns {names} against {wanted_names}"
    if len(found) != len(wanted):
        return f"{len(found)} rows against {len(wanted)}"
    for a, b in zip(found, wanted):
        kinds = [(type(x).__name__, type(y).__name__) for x, y in zip(a, b) if x is not None and y is not None]
        if a != b or any(x != y for x, y in kinds):
            return f"{a} against {b}"
    return None
