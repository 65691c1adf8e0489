"""Running totals over data of any size.

A window over ``partitionBy(group).orderBy(value)`` puts a whole group into one task. Here
the rows are range-partitioned by (group, value) instead, each range is summed on its own,
and the totals of the ranges before it, one small row per range, are added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from impactrec.staging import stage

_RANGE = "_range"


def _codes(batch: pa.RecordBatch, by: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """The group of each row as a number, and the groups."""
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    for c in by:
        encoded = batch.column(c).dictionary_encode()
        codes = codes * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False)
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    columns = [batch.column(c).take(pa.array(first)).to_pylist() for c in by]
    return codes, list(zip(*columns))


def _sums_within(by: list[str], sums: list[str]):
    """A task function that adds the running totals of each group among the rows of the task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict[tuple, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, groups = _codes(batch, by)
            rows = np.argsort(codes, kind="stable")
            ends = np.searchsorted(codes[rows], np.arange(len(groups)), side="right")
            totals = []
            for i, c in enumerate(sums):
                running = np.cumsum(batch.column(c).to_numpy(zero_copy_only=False)[rows])
                upto = running[ends - 1]
                before = np.concatenate([[0], upto[:-1]])
                shift = np.array([carried.get((key, i), 0) for key in groups]) - before
                running += np.repeat(shift, np.diff(ends, prepend=0))
                carried.update(((key, i), int(t)) for key, t in zip(groups, upto + shift))
                total = np.empty_like(running)
                total[rows] = running
                totals.append(pa.array(total))
            names = [*batch.schema.names, *[f"_local_{c}" for c in sums]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *totals], names=names)

    return add


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    sums: Sequence[str],
    keep: Sequence[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>``, the total of ``c`` up to and including the row, and ``total_<c>`` of the group.

    ``by`` and ``sums`` must not hold NULL, and ``sums`` are whole numbers. ``by`` and ``order``
    together must be unique: aggregate first, so that a frequent value is one row and no range
    can be skewed. The number of ranges is the session's, and AQE merges small ones, unless
    ``ranges`` is given. ``keep`` names the other columns the result needs, all by default.

    The rows are shuffled once. Sorting a range by ``order`` alone leaves its groups mixed,
    which the task keeps apart, and lets a single numeric column be sorted by radix. The rows
    are then written down, because two evaluations of a sampled range partitioning need not
    agree on the range of a row.
    """
    by, sums = list(by), list(sums)
    shown = df.columns if keep is None else list(dict.fromkeys([*by, *sums, *keep]))
    layout = [*by, *order] if ranges is None else [ranges, *by, *order]
    ranged = df.repartitionByRange(*layout).sortWithinPartitions(*order).select(*shown)
    local = [T.StructField(f"_local_{c}", T.LongType()) for c in sums]
    running = ranged.mapInArrow(_sums_within(by, sums), T.StructType([*ranged.schema.fields, *local]))
    summed = stage(running.withColumn(_RANGE, F.spark_partition_id()))

    # At most one row per range and one more per group; written, so that its size is known
    # when the join is planned.
    group = Window.partitionBy(*by)
    before = group.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    per_range = summed.groupBy(*by, _RANGE).agg(*[F.sum(c).alias(c) for c in sums])
    offsets = stage(
        per_range.select(
            *by,
            _RANGE,
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
            *[F.sum(c).over(group).alias(f"total_{c}") for c in sums],
        )
    )
    return summed.join(offsets, [*by, _RANGE]).select(
        *shown,
        *[(F.col(f"_local_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"total_{c}") for c in sums],
    )


def _next_within(by: list[str], cols: list[str]):
    """A task function that adds what follows each row in its group; the last row of a group in the task is open."""

    def rows(batch: pa.RecordBatch, at: np.ndarray, following: list[pa.Array], open_: bool, first: list) -> pa.RecordBatch:
        names = [*batch.schema.names, *[f"next_{c}" for c in cols], "_open", *[f"_first_{c}" for c in cols]]
        columns = [x.take(pa.array(at)) for x in batch.columns]
        return pa.RecordBatch.from_arrays([*columns, *following, pa.array(np.full(len(at), open_)), *first], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, pa.RecordBatch] = {}
        first: dict[tuple, list[pa.Array]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, groups = _codes(batch, by)
            order = np.argsort(codes, kind="stable")
            same = codes[order][1:] == codes[order][:-1]
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
            last = order[np.append(starts[1:], len(order)) - 1]
            values = [batch.column(c) for c in cols]
            none = [pa.nulls(int(same.sum()), v.type) for v in values]
            yield rows(batch, order[:-1][same], [v.take(pa.array(order[1:][same])) for v in values], False, none)
            for g, key in enumerate(groups):
                begin = [v.slice(int(order[starts[g]]), 1) for v in values]
                if key in held:
                    yield rows(held[key], np.array([0]), begin, False, [pa.nulls(1, v.type) for v in values])
                first.setdefault(key, begin)
                held[key] = batch.take(pa.array([int(last[g])]))
        for key, row in held.items():
            yield rows(row, np.array([0]), [pa.nulls(1, v.type) for v in first[key]], True, first[key])

    return add


def following_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """Add ``next_<c>``, the values of ``cols`` in the next row of the group, NULL in its last row.

    ``by`` must not hold NULL, and ``by`` and ``order`` together must be unique. The rows are range-partitioned
    once; across the borders of ranges one row per group and range is exchanged, so that no task
    sees a whole group.
    """
    by, cols = list(by), list(cols)
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*order)
    field = ranged.schema
    added = [T.StructField(f"next_{c}", field[c].dataType) for c in cols]
    added += [T.StructField("_open", T.BooleanType()), *[T.StructField(f"_first_{c}", field[c].dataType) for c in cols]]
    within = ranged.mapInArrow(_next_within(by, cols), T.StructType([*field.fields, *added]))
    found = stage(within.withColumn(_RANGE, F.spark_partition_id()))
    later = Window.partitionBy(*by).orderBy(_RANGE)
    borders = found.where("_open").select(*by, _RANGE, *[F.lead(f"_first_{c}").over(later).alias(f"_after_{c}") for c in cols])
    closed = found.where("NOT _open").select(*df.columns, *[f"next_{c}" for c in cols])
    ends = found.where("_open").join(stage(borders), [*by, _RANGE])
    return closed.unionByName(ends.select(*df.columns, *[F.col(f"_after_{c}").alias(f"next_{c}") for c in cols]))
