"""Feature vectors of columns with any number of values, without a model on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from impactrec.operators.encode import _category_counts
from impactrec.functions.ordering import running_totals
from impactrec.staging import stage, stage_path

#: Values of each column that are joined by broadcast; a value beyond them is at most this part of the rows.
FREQUENT_VALUES = 1000
_SPREAD = 1 << 16
_LONGEST = (1 << 31) - 1
_CELLS = VectorUDT.sqlType()


class Sparse(NamedTuple):
    """``table`` has the vectors, ``cells`` the same rows with ``(type, size, indices, values)`` in their place.

    ``slots`` names them: ``(position, feature, value)``, ``value`` NULL for a number.
    """

    table: DataFrame
    cells: DataFrame
    slots: DataFrame
    size: int


def vector_cells(df: DataFrame, vector_col: str) -> DataFrame:
    """``df``, written once, with a vector column as ``(type, size, indices, values)``, which it is in Parquet."""
    return _reread(df, vector_col, _CELLS)


def _reread(df: DataFrame, column: str, kind: T.DataType) -> DataFrame:
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    fields = [T.StructField(f.name, kind) if f.name == column else f for f in df.schema]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def value_slots(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, value, rank, position)`` of every known value: ranked by descending frequency, ties in
    value order, and one column after the other in ``position``, counted from 0."""
    counts = stage(_category_counts(df, cols).withColumn("one", F.lit(1).cast("bigint")))
    ranked = running_totals(counts, ["name"], [F.desc("n"), F.col("value")], ["one"], keep=["value"])
    ranks = stage(ranked.select(F.col("name").alias("feature"), "value", (F.col("cum_one") - 1).alias("rank")))
    sizes = {r["feature"]: r["n"] for r in ranks.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, before = F.lit(None).cast("bigint"), 0
    for c in cols:
        start = F.when(F.col("feature") == c, F.lit(before).cast("bigint")).otherwise(start)
        before += sizes.get(c, 0)
    return ranks.withColumn("position", start + F.col("rank"))


def _with_position(df: DataFrame, c: str, slots: DataFrame, output: str, spread: Column) -> DataFrame:
    """Add the position of the value of ``c``, NULL for an unknown one.

    Frequent values are looked up in a broadcast table of bounded size. Their rows, and those without a value, go into
    the join with the rare values under keys of their own, so that no task gets more of them than others.
    """
    found = slots.where(F.col("feature") == c)
    frequent = found.where(F.col("rank") < FREQUENT_VALUES).select(F.col("value").alias("_frequent"), F.col("position").alias("_near"))
    rare = found.where(F.col("rank") >= FREQUENT_VALUES).select(
        F.col("value").alias("_rare"), F.lit(0).cast("bigint").alias("_zero"), F.col("position").alias("_far")
    )
    value = F.col(c).cast("string")
    df = df.join(F.broadcast(frequent), value == F.col("_frequent"), "left")
    open_ = value.isNotNull() & F.col("_near").isNull()
    df = df.withColumns({
        "_value": F.when(open_, value).otherwise(F.lit("")),
        "_apart": F.when(open_, F.lit(0).cast("bigint")).otherwise(spread),
    })
    df = df.join(rare, (F.col("_value") == F.col("_rare")) & (F.col("_apart") == F.col("_zero")), "left")
    return df.withColumn(output, F.coalesce("_near", "_far")).drop(
        "_frequent", "_near", "_value", "_apart", "_rare", "_zero", "_far"
    )


def sparse_features(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str] = (), output: str = "features") -> Sparse:
    """One-hot slots of all values of some columns, then the numbers, as sparse vectors.

    The table of values is ranked along ranges and joined to the rows; the vectors are assembled from the positions found. Only
    the number of values of each column reaches the driver. A NULL has no slot. A missing number is 0.
    ``df`` must not have columns that start with ``_``.
    """
    rows = stage(df)
    slots = stage(value_slots(rows, categorical).select("feature", "value", "rank", "position"))
    n_values = slots.count()
    size = n_values + len(numeric)
    if size > _LONGEST:
        raise ValueError(f"{size} slots are more than a vector can have; leave columns out")
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(_SPREAD)) + 1
    found, places = rows, []
    for i, c in enumerate(categorical):
        found = _with_position(found, c, slots, f"_p{i}", spread)
        places.append(F.struct(F.col(f"_p{i}").cast("int").alias("at"), F.lit(1.0).alias("value")))
    for i, c in enumerate(numeric):
        number = F.nanvl(F.col(c).cast("double"), F.lit(0.0))
        places.append(F.struct(F.lit(n_values + i).alias("at"), F.coalesce(number, F.lit(0.0)).alias("value")))
    cells = F.filter(F.array(*places), lambda x: x["at"].isNotNull() & (x["value"] != 0.0))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.transform(cells, lambda x: x["at"]).alias("indices"),
        F.transform(cells, lambda x: x["value"]).alias("values"),
    )
    path = stage_path(df.sparkSession)
    found.select(*df.columns, vector.alias(output)).write.parquet(path)
    read = lambda kind: df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField(output, kind)])).parquet(path)
    names = slots.select("position", "feature", "value")
    if numeric:
        numbers = [(n_values + i, c, None) for i, c in enumerate(numeric)]
        names = names.unionByName(df.sparkSession.createDataFrame(numbers, "position bigint, feature string, value string"))
    return Sparse(read(VectorUDT()), read(_CELLS), names, size)
