"""Small helpers for tables that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that may be broadcast: with at most 50 bytes a row, some 50 MB.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcasting if it has few rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(key: str = "doc_id", modulus: int = 4) -> Column:
    """True for the part of the rows, one in ``modulus``, that no model may learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == 2, F.lit(False))
