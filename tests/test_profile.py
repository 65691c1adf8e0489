import numpy as np
import pytest
from pyspark.sql import functions as F

from impactrec.operators import (
    column_histogram,
    count_missing,
    count_where,
    describe_long,
    distinct_values,
    duplicate_rows,
    histograms,
    preview,
    profile,
    quantiles,
    top_values,
    value_counts,
)


def test_duplicates_count_nulls_as_equal(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, None), (None, None), (2, None)]
    table = spark.createDataFrame(rows, "k int, v string")
    assert {tuple(r) for r in duplicate_rows(table).collect()} == {(1, "a"), (None, None)}
    assert {r.k for r in duplicate_rows(table, ["k"]).collect()} == {1, None}


def test_duplicates_by_hash_are_the_same(spark):
    rows = [(1.0, None), (1.0, None), (None, "a"), (0.0, "z"), (-0.0, "z"), (float("nan"), "n"), (float("nan"), "n")]
    # A third of the rows are copies of one.
    rows += [(float(i), f"v{i}") for i in range(10, 200)] + [(7.0, "hot")] * 100
    table = spark.createDataFrame(rows, "x double, s string").repartition(6)
    found = sorted(map(repr, duplicate_rows(table, by_hash=True).collect()))
    assert found == sorted(map(repr, duplicate_rows(table).collect())) and len(found) == 4


def test_preview(spark):
    table = spark.range(100).withColumn("id", 99 - F.col("id"))
    assert [r.id for r in preview(table, 3, "id").collect()] == [0, 1, 2]
    assert preview(table).count() == 20


def test_missing_and_counts(products):
    row = count_missing(products, "Manufacturing_location").first()
    assert (row.n_sentinel, row.n_missing) == (108, 226)
    assert count_where(products, F.col("Type") == "promo").first()["count"] > 0
    counts = value_counts(products, "EI").collect()
    assert [r.EI for r in counts] == [1, 2, 3, 4, 5] and sum(r["count"] for r in counts) == 2000
    assert distinct_values(products, "Washing_instruction").count() == 5


def test_describe_agrees_with_spark(products):
    ours = {(r.column_name, r.stat): r.value if r.value is not None else r.text for r in describe_long(products).collect()}
    for row in products.describe().collect():
        for name, value in row.asDict().items():
            if name == "summary" or value is None:
                continue
            mine = ours.get((name, row.summary))
            if isinstance(mine, float):
                assert mine == pytest.approx(float(value), rel=1e-9)
            elif mine is not None:
                assert mine == value


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1001])
def test_quantiles_agree_with_numpy(spark, n):
    draw = np.random.default_rng(n)
    # A third of the rows share one value.
    values = np.where(draw.random(n) < 0.33, 5.0, draw.normal(size=n))
    table = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = {r.probability: r.value for r in quantiles(table, ["x"], wanted).collect()}
    assert found == pytest.approx({p: float(np.quantile(values, p)) for p in wanted})


def test_quantiles_leave_out_missing_values(spark):
    table = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert quantiles(table, ["x"], [0.5]).first().value == 2.0


def test_exact_profile_of_gaps(spark):
    rows = [(1.0, "a", 2**53), (None, "NaN", 2**53 + 1), (float("nan"), None, None), (3.0, "b", 2**53)]
    table = spark.createDataFrame(rows, "x double, s string, big bigint")
    found = {r.column_name: r for r in profile(table, exact=True).collect()}
    assert (found["x"].n_missing, found["x"].n_distinct, found["x"].p50) == (2, 2, 2.0)
    assert (found["s"].n_missing, found["s"].n_distinct, found["s"].min_text) == (2, 2, "a")
    # Two keys that the same double stands for are still two.
    assert (found["big"].n_missing, found["big"].n_distinct) == (1, 2)


def test_sketched_profile_is_close(products):
    exact = {r.column_name: r for r in profile(products, exact=True).collect()}
    for row in profile(products.repartition(16)).collect():
        other = exact[row.column_name]
        assert (row.n_rows, row.n_missing, row.min_text, row.max_text) == (
            other.n_rows, other.n_missing, other.min_text, other.max_text)
        assert row.n_distinct == pytest.approx(other.n_distinct, rel=0.05)
        if other.mean is not None:
            assert (row.min, row.max) == (other.min, other.max)
            assert (row.mean, row.stddev) == pytest.approx((other.mean, other.stddev), rel=1e-9)
            span = other.max - other.min
            assert (row.p25, row.p75) == pytest.approx((other.p25, other.p75), abs=0.03 * span + 1e-9)


def test_profile_of_an_empty_column(spark):
    table = spark.createDataFrame([(None, None)], "x double, s string")
    for exact in (True, False):
        rows = {r.column_name: r for r in profile(table, exact=exact).collect()}
        assert rows["x"].n_missing == 1 and rows["x"].p50 is None and rows["s"].n_distinct == 0


def test_moments_of_large_values(spark):
    """Values far from zero with a small spread, whole and fractional."""
    ids = spark.range(100_000).select("id")
    table = ids.selectExpr("1700000000000000 + id AS whole", "1.7e9 + id / 100000 AS seconds", "1e9 + id * 1e-5 AS tight")
    spread = 28867.657796
    wanted = {
        "whole": (1.7e15 + 49999.5, spread), "seconds": (1.7e9 + 0.499995, spread / 1e5), "tight": (1e9 + 0.499995, spread / 1e5)
    }
    for exact in (True, False):
        for r in profile(table, exact=exact).collect():
            assert (r.mean, r.stddev) == pytest.approx(wanted[r.column_name], rel=1e-4, abs=0)
            assert r.mean == pytest.approx(wanted[r.column_name][0], rel=1e-13, abs=0)
    means = {r.column_name: r.value for r in describe_long(table).where("stat = 'mean'").collect()}
    assert means["whole"] == 1700000000049999.5


def test_dates_and_flags_are_profiled(spark):
    table = spark.sql("SELECT DATE'2024-01-02' AS d, TIMESTAMP'2024-01-02 03:04:05' AS t, true AS b, 1 AS n")
    for exact in (True, False):
        rows = {r.column_name: r for r in profile(table, exact=exact).collect()}
        assert rows["d"].min_text == "2024-01-02" and rows["t"].max_text == "2024-01-02 03:04:05" and rows["b"].min_text == "true"


def test_percentiles_have_names_of_their_own(spark):
    table = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    rows = {(r.column_name, r.stat): r.value for r in describe_long(table, percentiles=(0.001, 0.004, 0.5)).collect()}
    assert rows["x", "0.1%"] == pytest.approx(1.001) and rows["x", "0.4%"] == pytest.approx(1.004)
    assert rows["x", "50%"] == 1.5 and rows["y", "50%"] is None


def test_histogram(spark):
    table = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 9.99, 10, 10]] + [(None,)], "x double")
    rows = {r.bucket: r.n for r in column_histogram(table, "x", 5).collect()}
    assert rows == {0: 2, 1: 1, 2: 0, 3: 0, 4: 3}
    flat = spark.createDataFrame([(7.0,), (7.0,)], "x double")
    assert [(r.bucket, r.n) for r in column_histogram(flat, "x").collect()] == [(0, 2)]


def test_quantiles_of_many_values_shuffle_few(spark, monkeypatch):
    """300,000 values, a third of them equal: what is ranked is a small part, and the results are exact."""
    import importlib

    module = importlib.import_module("impactrec.operators.profile")
    table = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.rand(1)).alias("a"), F.col("id").alias("b"),
        F.when(F.col("id") % 2 == 0, F.exp(F.randn(2))).alias("c"), F.lit(None).cast("double").alias("none"),
    )
    table = module.stage(table)
    ranked, inside = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df: ranked.append(inside(df)) or ranked[-1])
    wanted = (0.0, 0.1, 0.5, 0.999, 1.0)
    for most in (200_000, 10):
        monkeypatch.setattr(module, "_WINDOW_ROWS", most)
        found = {(r.column_name, r.probability): r.value for r in quantiles(table, ["a", "b", "c", "none"], wanted).collect()}
        assert len(found) == 15
        data = table.toPandas()
        for (c, p), value in found.items():
            assert value == pytest.approx(data[c].dropna().quantile(p), rel=1e-12, abs=1e-12)
    assert ranked[0].count() < 0.06 * 3 * 300_000


def test_a_bracket_that_misses_is_opened(spark, monkeypatch):
    import importlib

    module = importlib.import_module("impactrec.operators.profile")
    monkeypatch.setattr(module, "RANK_ERROR", -0.2)
    table = spark.range(20_000).select(F.col("id").cast("double").alias("x"))
    assert [r.value for r in quantiles(table, ["x"], (0.5,)).collect()] == [9999.5]


def test_frequent_values_among_very_many(spark):
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 50 == 0, "often").when(F.col("id") % 101 == 0, "NaN").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("text"),
        F.when(F.col("id") % 99 == 0, 7.5).when(F.col("id") % 9 == 1, F.lit(None)).otherwise(F.rand(1)).alias("x"),
        (F.col("id") % 3 == 0).alias("flag"), F.lit(None).cast("int").alias("none"),
    ).repartition(7)
    found = {(r.column_name, r.value): r.n for r in top_values(rows).collect()}
    assert found == {("text", "often"): 4000, ("x", "7.5"): 2021, ("flag", "true"): 66_667, ("flag", "false"): 133_333}
    assert top_values(rows.where("false")).collect() == []
    with pytest.raises(ValueError, match="least_share"):
        top_values(rows, least_share=1e-9)


def test_histograms_of_odd_columns(spark):
    rows = [(1.0, 5, None), (float("nan"), 5, None), (4.0, 5, None), (float("inf"), None, None), (2.9, 5, None)]
    table = spark.createDataFrame(rows, "x double, same int, none double")
    found = [tuple(r) for r in histograms(table, bins=3).collect()]
    assert found == [("x", 0, 1.0, 2.0, 1), ("x", 1, 2.0, 3.0, 1), ("x", 2, 3.0, 4.0, 1), ("same", 0, 5.0, 5.0, 4)]
    assert histograms(table.where("false")).collect() == []


def test_histograms_work_out_a_bin_once(spark, monkeypatch):
    """A row is not compared with every bin: the aggregates of the scans do not grow with the bins."""
    import importlib

    module = importlib.import_module("impactrec.operators.profile")
    monkeypatch.setattr(module.F, "count_if", lambda *_: pytest.fail("an aggregate for each bin"))
    table = spark.range(1000).select((F.col("id") % 500).cast("int").alias("a"), F.lit(None).cast("double").alias("none"), F.lit(2.5).alias("b"))
    found = [tuple(r) for r in histograms(table, bins=499).collect()]
    assert found == [("a", i, float(i), i + 1.0, 4 if i == 498 else 2) for i in range(499)] + [("b", 0, 2.5, 2.5, 1000)]
