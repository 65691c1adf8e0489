"""Previews, duplicates, summaries, data profiles and frequency tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from impactrec.functions.bounds import RANK_ERROR, at_rank, merge_group, rank_sketches
from impactrec.functions.expressions import SENTINEL, is_missing
from impactrec.functions.ordering import running_totals
from impactrec.staging import stage

QUARTILES = (0.25, 0.5, 0.75)

# Values that a few tasks can rank by a window; more are ranked along ranges.
_WINDOW_ROWS = 200_000

def preview(df: DataFrame, n: int = 20, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The first rows, by key where one is given; runs as a top-k, not a full sort."""
    if order_by is None:
        return df.limit(n)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None, by_hash: bool = False) -> DataFrame:
    """One copy of every row that occurs more than once. NULLs count as equal.

    Copies are combined on the map side, so a row repeated billions of times is no hot key.
    ``by_hash`` suits a wide stored table with few copies: a first scan shuffles only a hash
    per row, and a second one compares in full those rows whose hash occurred twice.
    """
    names = list(cols or df.columns)
    rows = df.select(*names)
    if by_hash:
        hashed = rows.withColumn("_hash", F.xxhash64(*names))
        repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
        # Written, so that the join knows its size and broadcasts it only if it is small.
        rows = hashed.join(stage(repeated), "_hash", "left_semi")
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*names)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency table in value order."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(column)


def count_where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg(F.count_if(predicate).alias("count"))


def count_missing(df: DataFrame, column: str, sentinel: str = SENTINEL) -> DataFrame:
    """How often the sentinel text occurs, and how often the value is NULL or the sentinel."""
    return df.agg(
        F.count_if(F.col(column) == sentinel).alias("n_sentinel"),
        F.count_if(is_missing(column, sentinel)).alias("n_missing"),
    )


def _is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _described(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    """The given columns, or all whose values have an order that text can show."""
    if cols is not None:
        return list(cols)
    kinds = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def _mean(df: DataFrame, column: str, value: Column) -> Column:
    """The mean as a double; whole numbers are added exactly, as their sum may not fit a double."""
    if isinstance(df.schema[column].dataType, T.IntegralType):
        value = value.cast("decimal(29,10)")
    return F.avg(value).cast("double")


def value_frequencies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column_id, number, text, n)``: every value of every column with its count.

    All columns share one shuffle. Values are counted on the map side first, so neither a
    frequent value nor a nearly constant column makes a hot key. ``text`` holds strings, and
    the exact digits of types a double cannot hold.
    """
    exact_double = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)
    cells = []
    for i, c in enumerate(cols):
        kind = df.schema[c].dataType
        number = F.col(c).cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if isinstance(kind, exact_double) else F.col(c).cast("string")
        cells.append(F.struct(F.lit(i).alias("column_id"), number.alias("number"), text.alias("text")))
    return (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .groupBy("cell.column_id", "cell.number", "cell.text")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _column_name(cols: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in cols]), F.col("column_id")).alias("column_name")


def quantiles(df: DataFrame, cols: Sequence[str], probabilities: Sequence[float] = QUARTILES) -> DataFrame:
    """Exact interpolated quantiles ``(column_name, probability, value)``, at any data size.

    A sketch of every column brackets the ranks wanted; a second scan counts exactly what lies below and
    inside the brackets; only the values inside, some thousandths of all, are shuffled and ranked. A
    bracket that misses its rank is opened. A column without numbers has no rows.
    """
    numbers = {str(i): F.col(c).cast("double") for i, c in enumerate(cols)}
    known = df.select(*[F.when(~F.isnan(v), v).alias(i) for i, v in numbers.items()])
    sketched = rank_sketches(known, [], {i: F.col(i) for i in numbers}).select(
        *[
            F.struct(
                F.col(f"n_{i}").alias("n"),
                *[
                    F.when(F.col(f"n_{i}") > 0, at_rank(F.col(f"order_{i}"), float(p) + side * RANK_ERROR)).alias(f"b{k}_{side + 1}")
                    for k, p in enumerate(probabilities)
                    for side in (-1, 1)
                ],
            ).alias(i)
            for i in numbers
        ]
    ).first()
    # One bracket for each column and probability: the ranks in it, and the least and greatest value.
    brackets = []
    for i in numbers:
        if n := sketched[i]["n"]:
            for k, p in enumerate(probabilities):
                spot = float(p) * (n - 1)
                low = sketched[i][f"b{k}_0"] if p > RANK_ERROR else -math.inf
                high = sketched[i][f"b{k}_2"] if p < 1 - RANK_ERROR else math.inf
                brackets.append([i, float(p), spot, low, high])
    spark = df.sparkSession
    if not brackets:
        return spark.createDataFrame([], "column_name string, probability double, value double")
    counts = known.agg(*[
        F.struct(F.count_if(F.col(i) < low).alias("below"), F.count_if(F.col(i) <= high).alias("upto")).alias(str(k))
        for k, (i, _, _, low, high) in enumerate(brackets)
    ]).first()
    plan, cells, hits = [], [], []
    for k, (i, p, spot, low, high) in enumerate(brackets):
        below = counts[str(k)]["below"]
        if not (below <= math.floor(spot) and math.ceil(spot) < counts[str(k)]["upto"]):
            low, high, below = -math.inf, math.inf, 0
        plan.append((k, cols[int(i)], p, math.floor(spot) - below, math.ceil(spot) - below, spot - math.floor(spot)))
        hits.append(F.col(i).between(low, high))
        cells.append(F.when(hits[-1], F.struct(F.lit(k).alias("bracket"), F.col(i).alias("number"))))
    inside = stage(
        known.where(reduce(or_, hits)).select(F.explode(F.array(*cells)).alias("cell")).where("cell IS NOT NULL")
        .groupBy("cell.bracket", "cell.number").agg(F.count(F.lit(1)).alias("n"))
    )
    if inside.count() <= _WINDOW_ROWS:
        upto = Window.partitionBy("bracket").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
        ranked = inside.withColumn("cum_n", F.sum("n").over(upto))
    else:
        ranked = running_totals(inside, ["bracket"], [F.col("number")], ["n"])
    wanted = spark.createDataFrame(plan, "bracket int, column_name string, probability double, low long, high long, weight double")
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    at = {side: F.when(F.col(side).between(first, last), F.col("number")) for side in ("low", "high")}
    held = ranked.join(F.broadcast(wanted), "bracket").where(at["low"].isNotNull() | at["high"].isNotNull())
    ends = held.groupBy("column_name", "probability", "weight").agg(F.max(at["low"]).alias("a"), F.max(at["high"]).alias("b"))
    return ends.select("column_name", "probability", (F.col("a") + (F.col("b") - F.col("a")) * F.col("weight")).alias("value"))


def _percent_name(probability: float) -> str:
    return f"{float(probability) * 100:.12g}%"


def describe_long(
    df: DataFrame, cols: Sequence[str] | None = None, percentiles: Sequence[float] = ()
) -> DataFrame:
    """``(column_name, stat, value, text)``: count, mean, stddev, min and max of every column.

    One aggregate covers all columns. A string column has a count, and its least and greatest
    value in ``text``. ``percentiles`` adds exact quantiles.
    """
    names = _described(df, cols)
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = []
    for c in names:
        numeric = _is_numeric(df, c)
        stats = {"count": F.count(c).cast("double"), "min": F.min(c), "max": F.max(c)}
        if numeric:
            stats |= {"mean": _mean(df, c, F.col(c)), "stddev": F.stddev_samp(c)}
        for name, value in stats.items():
            as_text = not numeric and name != "count"
            cells.append(
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(name).alias("stat"),
                    (no_number if as_text else value.cast("double")).alias("value"),
                    (value.cast("string") if as_text else no_text).alias("text"),
                )
            )
    summary = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    if not percentiles:
        return summary
    numbers = [c for c in names if _is_numeric(df, c)]
    # A column without values has its rows too.
    wanted = [(c, float(p), _percent_name(p)) for c in numbers for p in percentiles]
    named = df.sparkSession.createDataFrame(wanted, "column_name string, probability double, stat string")
    found = named.join(quantiles(df, numbers, percentiles), ["column_name", "probability"], "left")
    return summary.unionByName(found.select("column_name", "stat", "value", no_text.alias("text")))


def profile(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """One row per column: counts, missing and distinct values, range, mean, stddev, quartiles.

    By default distinct counts and quartiles come from mergeable sketches in a single scan.
    ``exact=True`` counts every value of every column in one shared shuffle instead.
    NULL, NaN, and the text ``NaN`` count as missing.
    """
    names = _described(df, cols)
    return _exact_profile(df, names) if exact else _sketched_profile(df, names)


def _exact_profile(df: DataFrame, names: list[str]) -> DataFrame:
    frequencies = value_frequencies(df, names)
    known_number = F.col("number").isNotNull() & ~F.isnan("number")
    known_text = F.col("number").isNull() & F.col("text").isNotNull() & (F.col("text") != SENTINEL)
    known = known_number | known_text
    counted = frequencies.groupBy("column_id").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count_if(known).alias("n_distinct"),
        F.min(F.when(known_number, F.col("number"))).alias("min"),
        F.max(F.when(known_number, F.col("number"))).alias("max"),
        F.min(F.when(known_text, F.col("text"))).alias("min_text"),
        F.max(F.when(known_text, F.col("text"))).alias("max_text"),
    )
    # Moments of the rows themselves: their partial results merge without cancelling.
    moments = df.agg(F.array(*[_moments(df, i, c) for i, c in enumerate(names)]).alias("m")).select(F.inline("m"))
    numbers = [c for c in names if _is_numeric(df, c)]
    quarters = quantiles(df, numbers).groupBy("column_name").agg(
        *[
            F.max(F.when(F.col("probability") == p, F.col("value"))).alias(f"p{round(p * 100)}")
            for p in QUARTILES
        ]
    )
    # One row per column on either side.
    joined = counted.join(moments, "column_id").withColumn("column_name", _column_name(names))
    joined = joined.join(quarters, "column_name", "left")
    shown = ["n_rows", "n_missing", "n_distinct", "min", "max", "min_text", "max_text", "mean", "stddev"]
    return joined.select("column_name", *shown, *[c for c in quarters.columns if c != "column_name"])


def _moments(df: DataFrame, i: int, column: str) -> Column:
    """Position, mean and standard deviation of a column; the latter two NULL unless it is numeric."""
    mean = stddev = F.lit(None).cast("double")
    if _is_numeric(df, column):
        value = F.col(column)
        if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(column), value)
        mean, stddev = _mean(df, column, value), F.stddev_samp(value)
    return F.struct(F.lit(i).alias("column_id"), mean.alias("mean"), stddev.alias("stddev"))


def _sketched_profile(df: DataFrame, names: list[str]) -> DataFrame:
    parts, cells = [F.count(F.lit(1)).alias("rows")], []
    rows = F.sum("rows")
    for i, c in enumerate(names):
        numeric = _is_numeric(df, c)
        whole = isinstance(df.schema[c].dataType, T.IntegralType)
        raw = F.col(c).cast("double" if numeric else "string")
        known = raw.isNotNull() & (~F.isnan(raw) if numeric else raw != SENTINEL)
        value = F.when(known, raw)
        parts += [
            F.count(value).alias(f"n{i}"),
            F.min(value).alias(f"min{i}"),
            F.max(value).alias(f"max{i}"),
            F.hll_sketch_agg(F.when(known, F.xxhash64(c))).alias(f"distinct{i}"),
        ]
        low, high = F.min(f"min{i}"), F.max(f"max{i}")
        mean = stddev = F.lit(None).cast("double")
        quarters = [F.lit(None).cast("double")] * len(QUARTILES)
        if numeric:
            parts += [
                _mean(df, c, F.when(known, F.col(c))).alias(f"mean{i}"),
                F.var_pop(value).alias(f"var{i}"),
                F.sum(F.when(known, F.col(c)).cast("decimal(20,0)") if whole else value).alias(f"sum{i}"),
                F.kll_sketch_agg_double(value).alias(f"order{i}"),
            ]
            n = F.col(f"n{i}")
            filled = F.struct(n.alias("n"), F.col(f"mean{i}").alias("m"), F.col(f"var{i}").alias("v"))
            mean, stddev = _merged_moments(F.collect_list(F.when(n > 0, filled)), F.sum(n))
            if whole:
                mean = (F.sum(f"sum{i}") / F.nullif(F.sum(n), F.lit(0))).cast("double")
            merged = F.kll_merge_agg_double(f"order{i}")
            quarters = [F.kll_sketch_get_quantile_double(merged, F.lit(p)) for p in QUARTILES]
            quarters = [F.when(F.sum(n) > 0, q) for q in quarters]
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                rows.alias("n_rows"),
                (rows - F.sum(f"n{i}")).alias("n_missing"),
                F.hll_sketch_estimate(F.hll_union_agg(f"distinct{i}")).alias("n_distinct"),
                (low if numeric else F.lit(None).cast("double")).alias("min"),
                (high if numeric else F.lit(None).cast("double")).alias("max"),
                (F.lit(None).cast("string") if numeric else low).alias("min_text"),
                (F.lit(None).cast("string") if numeric else high).alias("max_text"),
                mean.alias("mean"),
                stddev.alias("stddev"),
                *[q.alias(f"p{round(p * 100)}") for p, q in zip(QUARTILES, quarters)],
            )
        )
    first = df.groupBy(merge_group()).agg(*parts)
    return first.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _merged_moments(groups: Column, rows: Column) -> tuple[Column, Column]:
    """Mean and standard deviation from counts, means and variances of at most ``MERGE_FANOUT`` groups.

    Everything is taken relative to the first group's mean and then to the mean of all, so that no
    large numbers cancel.
    """
    total, first, zero = F.nullif(rows, F.lit(0)), F.get(groups, F.lit(0))["m"], F.lit(0.0)
    mean = first + F.aggregate(groups, zero, lambda s, g: s + g["n"] * (g["m"] - first)) / total
    squares = F.aggregate(groups, zero, lambda s, g: s + g["n"] * (g["v"] + (g["m"] - mean) * (g["m"] - mean)))
    return mean, F.sqrt(squares / F.nullif(rows - 1, F.lit(0)))


def column_histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram ``(bucket, lower, upper, n)`` between the least and greatest value.

    Empty bins have a row; a column of one value has one bin.
    """
    value = F.col(column).cast("double")
    known = df.select(value.alias("v")).where(value.isNotNull() & ~F.isnan(value))
    # The two bounds reach the scan as a one-row scalar subquery.
    bounds = known.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("b")).scalar()
    low, width = bounds["lo"], (bounds["hi"] - bounds["lo"]) / bins
    place = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    )
    filled = known.groupBy(place.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bucket"))
    every = every.where((width > 0) | ((F.col("bucket") == 0) & (width == 0)))
    return every.join(filled, "bucket", "left").select(
        "bucket", (low + F.col("bucket") * width).alias("lower"),
        (low + (F.col("bucket") + 1) * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def top_values(df: DataFrame, cols: Sequence[str] | None = None, least_share: float = 0.01) -> DataFrame:
    """``(column_name, value, n, share)``: every value that at least ``least_share`` of a column's rows hold.

    Two scans for all columns. A mergeable sketch of frequent items finds candidates: it tracks so many values
    that none above half of ``least_share`` can be missed. The second scan counts the candidates exactly. NULL,
    NaN and the text ``NaN`` are no values, but their rows count for the share. Values are shown as text.
    """
    names = _described(df, cols)
    # A sketch of m values (a power of two) can miss what fewer than 3.5 / m of the rows hold.
    tracked = 1 << max(6, math.ceil(math.log2(7 / least_share)))
    if tracked > 1_000_000:
        raise ValueError(f"least_share must be at least {7 / 2**19:.2g}")
    shown = {f"v{i}": F.col(c).cast("string") for i, c in enumerate(names)}
    known = df.select(*[F.coalesce(v, F.lit(SENTINEL)).alias(i) for i, v in shown.items()])
    shape = "column_name string, value string, n long, share double"
    if known.isEmpty():
        return df.sparkSession.createDataFrame([], shape)
    first = known.groupBy(merge_group()).agg(
        F.count(F.lit(1)).alias("rows"), *[F.expr(f"approx_top_k_accumulate({i}, {tracked})").alias(i) for i in shown]
    )
    merged = [F.expr(f"approx_top_k_estimate(approx_top_k_combine({i}, {tracked}), {math.ceil(2 / least_share)})").alias(i) for i in shown]
    sketched = first.agg(F.sum("rows").alias("rows"), *merged).first()
    rows = sketched["rows"]
    found = {i: sorted(x["item"] for x in sketched[i] or () if x["item"] != SENTINEL and 2 * x["count"] >= least_share * rows) for i in shown}
    counted = known.agg(
        *[F.array(*[F.count_if(F.col(i) == F.lit(v)) for v in found[i]]).cast("array<long>").alias(i) for i in shown]
    ).first()
    table = [
        (c, v, n, n / rows)
        for i, c in zip(shown, names)
        for v, n in zip(found[i], counted[i])
        if n >= least_share * rows and n
    ]
    return df.sparkSession.createDataFrame(table, shape)


def histograms(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """``(column_name, bucket, lower, upper, n)``: equal-width histograms of all numeric columns together.

    One scan finds the ends of every column; a second turns each row into a cell per column, whose bin is worked
    out once, and counts cells on the map side, so that only counts are shuffled. Empty bins have a row; a column
    of one value has one bin, and one without numbers none.
    """
    names = [c for c in _described(df, cols) if _is_numeric(df, c)]
    shape = "column_name string, bucket int, lower double, upper double, n long"
    if not names:
        return df.sparkSession.createDataFrame([], shape)
    values = {f"v{i}": F.col(c).cast("double") for i, c in enumerate(names)}
    finite = df.select(*[F.when(~F.isnan(v) & (F.abs(v) < math.inf), v).alias(i) for i, v in values.items()])
    ends = finite.agg(*[F.struct(F.min(i).alias("low"), F.max(i).alias("high")).alias(i) for i in values]).first()
    # (position, name, least value, width of a bin) of the columns with numbers.
    plan = [(k, c, low, (high - low) / bins) for k, (c, (low, high)) in enumerate(zip(names, ends)) if low is not None]
    if not plan:
        return df.sparkSession.createDataFrame([], shape)
    cells = finite.select(F.posexplode(F.array(*[F.col(f"v{k}") for k, *_ in plan])).alias("at", "v")).where("v IS NOT NULL")
    low, width = (F.get(F.array(*[F.lit(x[side]) for x in plan]), F.col("at")) for side in (2, 3))
    place = F.least(F.floor((F.col("v") - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    filled = cells.groupBy("at", F.when(width == 0, F.lit(0)).otherwise(place).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counted = {(r["at"], r["bucket"]): r["n"] for r in filled.collect()}
    table = [
        (c, b, low + b * width, low + (b + 1) * width, counted.get((at, b), 0))
        for at, (_, c, low, width) in enumerate(plan)
        for b in range(bins if width else 1)
    ]
    return df.sparkSession.createDataFrame(table, shape)
