"""Correlation, and chi-square tests of independence."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

NULL_RULES = ("zero", "pairwise")
# What rounding leaves of a sum of squares less the square of the sum.
_ROUNDING = 1e-13
_SUMS = ["i", "j", "n", "sx", "sy", "sxy", "sxx", "syy"]


def _check_rule(nulls: str) -> None:
    if nulls not in NULL_RULES:
        raise ValueError(f"nulls must be one of {NULL_RULES}")


def _pearson(a: Column, b: Column) -> Column:
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def corr_pair(df: DataFrame, a: str, b: str, nulls: str = "zero") -> DataFrame:
    """Pearson correlation of two columns; NULL if either is constant.

    ``zero`` reads a NULL as 0; ``pairwise`` leaves out rows where either side is NULL.
    """
    _check_rule(nulls)
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    if nulls == "zero":
        x, y = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
    else:
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
    return df.agg(_pearson(x, y).alias("corr"))


def _pair_sums(shifts: np.ndarray):
    """A task function that reduces its rows to sums per pair of columns, of values less their shift.

    Per batch the sums are matrix products. Entry ``[i, j]`` covers the rows where both columns have
    a value.
    """
    width = len(shifts)

    def of_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        seen = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
        x = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], dtype=float) - shifts[:, None]
        if seen.all():
            wide = np.ones((1, width))
            squares = (x * x).sum(axis=1, keepdims=True)
            return batch.num_rows * wide.T @ wide, x.sum(axis=1, keepdims=True) @ wide, x @ x.T, squares @ wide
        x, mask = np.where(seen, x, 0.0), seen.astype(float)
        return mask @ mask.T, x @ mask.T, x @ x.T, (x * x) @ mask.T

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_batch(batch)
                total = part if total is None else tuple(a + b for a, b in zip(total, part))
        if total is not None:
            n, first, cross, second = total
            i, j = np.triu_indices(width, 1)
            columns = [i, j, n[i, j], first[i, j], first[j, i], cross[i, j], second[i, j], second[j, i]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_SUMS)

    return reduce_rows


def corr_matrix(df: DataFrame, cols: Sequence[str], nulls: str = "zero") -> DataFrame:
    """``(var_x, var_y, corr)`` for every ordered pair of different columns, in two scans.

    The first finds the mean of every column, the second sums of products of deviations from it, which
    do not cancel. Every task reduces its rows to one small row per pair, and these are added up by
    an ordinary aggregate. A pair with a constant column has a NULL correlation.
    """
    _check_rule(nulls)
    names = list(cols)
    values = [F.col(c).cast("double") for c in names]
    if nulls == "zero":
        values = [F.coalesce(v, F.lit(0.0)) for v in values]
    rows = df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)])
    finite = [F.when(F.abs(c) < float("inf"), F.col(c)) for c in rows.columns]
    shifts = np.array([m or 0.0 for m in rows.agg(*[F.avg(c) for c in finite]).first()])
    shape = ", ".join(f"{c} {'bigint' if c in 'ij' else 'double'}" for c in _SUMS)
    parts = rows.mapInArrow(_pair_sums(shifts), shape).groupBy("i", "j")
    total = parts.agg(*[F.sum(c).alias(c) for c in _SUMS[2:]]).where("n > 0")
    n = F.col("n")
    summed = total.select(
        "i", "j", "sxx", "syy",
        (F.col("sxy") - F.col("sx") * F.col("sy") / n).alias("c"),
        (F.col("sxx") - F.col("sx") * F.col("sx") / n).alias("vx"),
        (F.col("syy") - F.col("sy") * F.col("sy") / n).alias("vy"),
    )
    # A constant column leaves nothing but the rounding error of its sums; NaN stays NaN.
    flat = (F.col("vx") <= _ROUNDING * F.col("sxx")) | (F.col("vy") <= _ROUNDING * F.col("syy"))
    flat = flat & ~F.isnan("c")
    corr = F.col("c") / F.nullif(F.sqrt("vx") * F.sqrt("vy"), F.lit(0.0))
    bounded = F.when(F.isnan(corr), corr).otherwise(F.greatest(F.least(corr, F.lit(1.0)), F.lit(-1.0)))
    name = F.array(*[F.lit(c) for c in names])
    x, y = F.get(name, F.col("i")), F.get(name, F.col("j"))
    both_ways = F.array(
        F.struct(x.alias("var_x"), y.alias("var_y")), F.struct(y.alias("var_x"), x.alias("var_y"))
    )
    return summed.select(F.explode(both_ways).alias("pair"), F.when(~flat, bounded).alias("corr")).select(
        "pair.var_x", "pair.var_y", "corr"
    )


def chi_square(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """``(feature, statistic, degrees_of_freedom, n)`` of each column against the label.

    Every distinct value is a category. All columns share one contingency table, counted on
    the map side. With ``o`` the cell, ``r`` the value's and ``c`` the label's total, the
    statistic is ``n * (sum(o^2 / (r * c)) - 1)``, so empty cells need not exist and the
    sums over values are ordinary aggregates: no join, and no group held in one task.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols
    ])
    observed = (
        df.select(F.col(label).alias("label"), F.explode(cells).alias("cell"))
        .groupBy("cell.feature", "cell.value", "label")
        .agg(F.count(F.lit(1)).alias("o"))
    )
    # A (feature, value) group holds one row per label.
    per_value = Window.partitionBy("feature", "value")
    spread = observed.select(
        "feature", "label", "o",
        F.sum("o").over(per_value).alias("r"),
        (F.row_number().over(per_value.orderBy("label")) == 1).cast("bigint").alias("new_value"),
    )
    per_label = spread.groupBy("feature", "label").agg(
        F.sum(F.col("o").cast("double") * F.col("o") / F.col("r")).alias("s"),
        F.sum("o").alias("c"),
        F.sum("new_value").alias("values"),
    )
    return per_label.groupBy("feature").agg(
        (F.sum("c") * (F.sum(F.col("s") / F.col("c")) - 1)).alias("statistic"),
        ((F.sum("values") - 1) * (F.count(F.lit(1)) - 1)).alias("degrees_of_freedom"),
        F.sum("c").alias("n"),
    )


def upper_tail(statistic: float, degrees: int) -> float:
    """The chance that a chi-square variable exceeds ``statistic``: the regularised upper gamma function."""
    a, x = degrees / 2, statistic / 2
    if degrees <= 0 or x <= 0:
        return 1.0
    scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - math.exp(scale) * total)
    # Continued fraction of the upper function, by the modified Lentz method.
    b = x + 1 - a
    c, d = 1e300, 1 / b
    total, i = d, 0
    while True:
        i += 1
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        total *= c * d
        if abs(c * d - 1) < 1e-15:
            return math.exp(scale) * total


def chi_square_test(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """``chi_square`` with ``p_value``, by which columns of unequal degrees of freedom compare.

    The tested table has one row per column and passes through the driver.
    """
    rows = [(*r, upper_tail(r.statistic, r.degrees_of_freedom)) for r in chi_square(df, cols, label).collect()]
    shape = "feature string, statistic double, degrees_of_freedom bigint, n bigint, p_value double"
    return df.sparkSession.createDataFrame(rows, shape)
