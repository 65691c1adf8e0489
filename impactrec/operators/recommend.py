"""Ranked recommendations from a scored product table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from impactrec.functions.bounds import RANK_ERROR, at_least_rank, rank_sketches
from impactrec.functions.expressions import scores_array
from impactrec.functions.ordering import running_totals
from impactrec.sources.schema import KEY, LABEL
from impactrec.staging import stage

# A frequent type is cut in this many parts before its best rows meet in one task.
_PARTS = 64


def recommend(
    scored: DataFrame,
    classes: Sequence[int] = (1, 2),
    by: str = "probability",
    type: str | None = None,
    n: int | None = None,
    per_type: bool = False,
    key: str = KEY,
    label: str = LABEL,
) -> DataFrame:
    """Products predicted to be in the best classes, the best first.

    ``by`` names a score column, ordered slot by slot, greatest first, or is ``prediction``
    for the order of the classes. Ties go by key. ``type`` keeps one garment type, and
    ``per_type`` returns the ``n`` best of every type with their ``rank``. Without ``n`` all are returned.
    """
    best = scored.where(F.col("prediction").isin([float(c) for c in classes]))
    if type is not None:
        best = best.where(F.col("Type") == type)
    if by == "prediction":
        shown, order = F.col("prediction"), [F.col("prediction").asc(), F.col(key).asc()]
    else:
        shown = scores_array(scored, by).alias(by)
        order = [F.col(by).desc(), F.col(key).asc()]
    table = best.select(key, "Type", shown, label)
    if per_type:
        return _top_per_type(table, order, n, key)
    ordered = table.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def _top_per_type(table: DataFrame, order: list[Column], n: int | None, key: str) -> DataFrame:
    shown = table.columns
    spark = table.sparkSession
    limit = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n is not None and n <= limit:
        # Each task keeps the n best rows of a part; the n best of a type are among them.
        part = F.pmod(F.xxhash64(key), F.lit(_PARTS))
        first = table.withColumn("rank", F.row_number().over(Window.partitionBy("Type", part).orderBy(*order)))
        ranking = Window.partitionBy("Type").orderBy(*order)
        return first.where(F.col("rank") <= n).withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= n)
    if n is not None:
        table = can_be_best(stage(table), n)
    # A frequent type must not be ranked whole by one task: count along ranges instead.
    ones = table.select(
        "*",
        F.col("Type").isNull().alias("_untyped"),
        F.coalesce("Type", F.lit("")).alias("_type"),
        F.lit(1).cast("bigint").alias("one"),
    )
    ranked = running_totals(ones, ["_untyped", "_type"], order, ["one"]).select(
        *shown, F.col("cum_one").cast("int").alias("rank")
    )
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def can_be_best(table: DataFrame, n: int) -> DataFrame:
    """The rows of each type that can be among its ``n`` best, and few others: no row is shuffled to find them.

    The third column is the score. Scores of several slots are compared by the first slot in which any
    differ. A sketch of that slot gives a value that about ``n`` rows reach; rows below it stay behind if
    a count shows that so many do reach it, else all rows of the type are kept. The table is read four
    times; stage an expensive plan.
    """
    score = table.columns[2]
    if score == "prediction":
        ahead = F.array(-F.col(score))
    else:
        ahead = F.col(score)
    rows = table.withColumn("_ahead", ahead)
    ends = rows.groupBy("Type").agg(F.min("_ahead").alias("low"), F.max("_ahead").alias("high"))
    differ = F.arrays_zip(F.col("low").alias("a"), F.col("high").alias("b"))
    slot = F.array_position(F.transform(differ, lambda x: ~x["a"].eqNullSafe(x["b"])), True)
    leads = stage(ends.select(F.col("Type").alias("_t"), F.greatest(slot - 1, F.lit(0)).cast("int").alias("_slot")))
    led = rows.join(leads, F.col("Type").eqNullSafe(F.col("_t")), "left").withColumn("_lead", F.get("_ahead", F.coalesce("_slot", F.lit(0))))
    sketched = rank_sketches(led, ["Type"], {"lead": F.col("_lead").cast("double")})
    reach = at_least_rank(F.col("order_lead"), 1 - F.lit(float(n)) / F.col("n_lead") - RANK_ERROR)
    bounds = stage(sketched.select(F.col("Type").alias("_b"), F.when(F.col("n_lead") > n, reach).alias("_bound")))
    same = F.col("Type").eqNullSafe(F.col("_b"))
    bounded = led.drop("_t").join(bounds, same, "left")
    enough = bounded.groupBy("Type").agg(F.count_if(F.col("_lead") >= F.col("_bound")).alias("reached"))
    safe = stage(
        enough.where(F.col("reached") >= n).join(bounds, same).select(F.col("Type").alias("_s"), F.col("_bound").alias("_safe"))
    )
    kept = led.drop("_t").join(safe, F.col("Type").eqNullSafe(F.col("_s")), "left")
    return kept.where(F.col("_safe").isNull() | (F.col("_lead") >= F.col("_safe"))).select(*table.columns)
