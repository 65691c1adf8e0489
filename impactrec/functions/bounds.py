"""Bounds from mergeable quantile sketches, by which most rows are left out before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Size of a sketch, and what it allows for: twice the rank error of that size (0.13 %).
SKETCH, RANK_ERROR = 4096, 0.0026

# Partial sketches are merged in two steps, first in this many groups of input tasks, so
# that no single task has to merge one sketch per task of a very large scan.
MERGE_FANOUT = 256


def merge_group() -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(MERGE_FANOUT)).alias("_merge")


def rank_sketches(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """Per group of ``by`` the number of values and a sketch of each: ``n_<name>`` and ``order_<name>``.

    Only numbers count; a name without any has a NULL sketch.
    """
    usable = {name: F.when(~F.isnan(v), v) for name, v in values.items()}
    first = df.groupBy(*by, merge_group()).agg(
        *[F.count(v).alias(f"n_{name}") for name, v in usable.items()],
        *[F.kll_sketch_agg_double(v, F.lit(SKETCH)).alias(f"order_{name}") for name, v in usable.items()],
    )
    filled = {name: F.when(F.col(f"n_{name}") > 0, F.col(f"order_{name}")) for name in values}
    parts = [F.sum(f"n_{name}").alias(f"n_{name}") for name in values]
    parts += [
        F.when(F.sum(f"n_{name}") > 0, F.kll_merge_agg_double(filled[name])).alias(f"order_{name}") for name in values
    ]
    return first.groupBy(*by).agg(*parts)


def at_rank(sketch: Column, share: float) -> Column:
    """The value at a share of the ranks, cut to 0 and 1."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(min(max(share, 0.0), 1.0)))


#: Steps of a share that is not known before the sketch: a fifth of the error.
_STEPS = 2000


def at_least_rank(sketch: Column, share: Column) -> Column:
    """The value at the last step up to a share that is a column; never above that at the share itself."""
    steps = F.array(*[F.lit(k / _STEPS) for k in range(_STEPS + 1)])
    at = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * _STEPS).cast("int")
    return F.get(F.kll_sketch_get_quantile_double(sketch, steps), at)
