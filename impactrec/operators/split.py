"""Splits into training and held-out parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from impactrec.functions.expressions import key_bucket
from impactrec.sources.schema import KEY
from impactrec.staging import stage

_BUCKETS = 1 << 32


def split_part(key: str, weights: Sequence[float], seed: int) -> Column:
    """Number of the part a key falls into; the same on every run, engine and partitioning."""
    total, bucket = sum(weights), key_bucket(key, seed, _BUCKETS)
    bounds = [int(_BUCKETS * sum(weights[: i + 1]) / total) for i in range(len(weights) - 1)]
    part = F.lit(len(weights) - 1)
    for i, bound in reversed(list(enumerate(bounds))):
        part = F.when(bucket < bound, i).otherwise(part)
    return part


def split_by_key(
    df: DataFrame, key: str = KEY, weights: Sequence[float] = (0.8, 0.2), seed: int = 42
) -> list[DataFrame]:
    """Disjoint parts by hashed key: filters over the input, with no shuffle and no sort."""
    part = split_part(key, weights, seed)
    return [df.where(part == i) for i in range(len(weights))]


def split_random(df: DataFrame, weights: Sequence[float] = (0.8, 0.2), seed: int = 42) -> list[DataFrame]:
    """Spark's own split: the same seed gives other rows once the partitioning changes.

    The rows are written first, as parts of rows that arrive in another order could overlap.
    """
    return stage(df).randomSplit(list(weights), seed)
