"""Column expressions shared by the operators. All run inside code generation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

SENTINEL = "NaN"


def is_missing(column: Column | str, sentinel: str = SENTINEL) -> Column:
    """NULL, or the text that stands for an unknown value."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | (c == sentinel)


def flag(predicate: Column) -> Column:
    """1 where the predicate holds, else 0; an unknown predicate gives 0."""
    return F.when(predicate, 1).otherwise(0)


def indicator(left: Column, right: Column) -> Column:
    """1.0 where both sides are equal, else 0.0."""
    return (left == right).cast("double")


def scores_array(df: DataFrame, column: str) -> Column:
    """A score column as an array, whether it is held as a vector or an array."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.col(column)
    return vector_to_array(F.col(column))


def slot(df: DataFrame, column: str, k: int) -> Column:
    """Element ``k`` of a vector or array column, NULL where there is none."""
    return F.get(scores_array(df, column), k)


def key_bucket(key: str, seed: int, modulus: int = 100) -> Column:
    """A bucket in ``[0, modulus)`` that depends on the key and seed alone.

    Taken from the first eight hex digits of an MD5 digest, so any engine can repeat it; they
    fill the range up to ``2 ** 32``. A NULL key is read as an empty text.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % modulus
