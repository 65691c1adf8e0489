import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import ChiSquareTest

from impactrec.operators.stats import upper_tail
from impactrec.operators import chi_square, corr_matrix, corr_pair, index_strings

GAPS = [(1.0, 2.0), (2.0, None), (3.0, 6.1), (None, 9.0), (5.0, 9.9), (6.0, 12.0)]


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(GAPS, "a double, b double")


def test_null_rules(gaps):
    filled = np.nan_to_num(np.array(GAPS, dtype=float))
    both = np.array([r for r in GAPS if None not in r], dtype=float)
    for rule, data in (("zero", filled), ("pairwise", both)):
        expected = np.corrcoef(data.T)[0, 1]
        assert corr_pair(gaps, "a", "b", rule).first()["corr"] == pytest.approx(expected)
        assert [r["corr"] for r in corr_matrix(gaps, ["a", "b"], rule).collect()] == pytest.approx([expected] * 2)
    # The zero rule is that of DataFrame.stat.corr.
    assert corr_pair(gaps, "a", "b").first()["corr"] == pytest.approx(gaps.stat.corr("a", "b"))
    with pytest.raises(ValueError):
        corr_matrix(gaps, ["a", "b"], "drop")


@pytest.mark.parametrize("rule", ["zero", "pairwise"])
def test_a_constant_column_has_no_correlation(spark, rule):
    for constant in (3.0, 0.1, 1e9, 0.0):
        table = spark.createDataFrame([(float(i), constant) for i in range(50)], "a double, b double").repartition(5)
        assert corr_pair(table, "a", "b", rule).first()["corr"] is None
        assert [r["corr"] for r in corr_matrix(table, ["a", "b"], rule).collect()] == [None, None]


@pytest.mark.parametrize("offset", [0.0, 1e7])
@pytest.mark.parametrize("parts", [1, 9])
def test_matrix_against_numpy(spark, offset, parts):
    draw = np.random.default_rng(1)
    data = draw.normal(size=(700, 5)) + offset
    data[:, 1] += 0.7 * data[:, 0]
    holes = draw.random(data.shape) < 0.2
    holes[:, 0] = False
    rows = [tuple(None if h else float(v) for v, h in zip(r, m)) for r, m in zip(data, holes)]
    names = list("abcde")
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(parts)
    for rule in ("zero", "pairwise"):
        found = {(r.var_x, r.var_y): r["corr"] for r in corr_matrix(table, names, rule).collect()}
        assert len(found) == 20
        for i, x in enumerate(names):
            for j, y in enumerate(names):
                if i == j:
                    continue
                keep = ~(holes[:, i] | holes[:, j]) if rule == "pairwise" else np.full(700, True)
                full = np.where(holes, 0.0, data) if rule == "zero" else data
                expected = np.corrcoef(full[keep, i], full[keep, j])[0, 1]
                assert found[x, y] == pytest.approx(expected, abs=1e-7)
                assert found[x, y] == found[y, x] and -1 <= found[x, y] <= 1


def test_small_batches_merge(spark):
    draw = np.random.default_rng(2)
    rows = [tuple(float(v) for v in r) for r in draw.normal(size=(500, 3))]
    table = spark.createDataFrame(rows, "a double, b double, c double").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {(r.var_x, r.var_y): r["corr"] for r in corr_matrix(table, ["a", "b", "c"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found["a", "b"] == pytest.approx(np.corrcoef(np.array(rows).T)[0, 1])


def test_nan_empty_and_single_rows(spark):
    schema = "a double, b double"
    nan = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (2.0, 5.0)], schema)
    assert math.isnan(corr_matrix(nan, ["a", "b"]).first()["corr"])
    assert corr_matrix(spark.createDataFrame([], schema), ["a", "b"]).collect() == []
    one = corr_matrix(spark.createDataFrame([(1.0, 2.0)], schema), ["a", "b"]).collect()
    assert [r["corr"] for r in one] == [None, None]


def test_chi_square_agrees_with_spark(products):
    cols = ["Type", "Use_location", "Washing_instruction"]
    ours = {r.feature: r for r in chi_square(products, [*cols, "Cotton"], "EI").collect()}
    indexed = index_strings(products, cols)
    inputs = [f"{c}_index" for c in cols] + ["Cotton"]
    table = VectorAssembler(inputCols=inputs, outputCol="f").transform(indexed)
    for row in ChiSquareTest.test(table, "f", "EI", flatten=True).collect():
        mine = ours[[*cols, "Cotton"][row.featureIndex]]
        assert mine.statistic == pytest.approx(row.statistic)
        assert mine.degrees_of_freedom == row.degreesOfFreedom
        assert mine.n == 2000


def test_chi_square_of_a_hot_value(spark):
    rows = [("x", i % 2) for i in range(400)] + [(f"v{i}", i % 2) for i in range(100)]
    row = chi_square(spark.createDataFrame(rows, "f string, y int"), ["f"], "y").first()
    # Brute force over every cell, empty ones included.
    values = {v for v, _ in rows}
    expected = 0.0
    for v in values:
        for y in (0, 1):
            observed = sum(r == (v, y) for r in rows)
            wanted = sum(r[0] == v for r in rows) * sum(r[1] == y for r in rows) / len(rows)
            expected += (observed - wanted) ** 2 / wanted
    assert row.statistic == pytest.approx(expected) and row.degrees_of_freedom == 100


def test_pair_and_matrix_agree(spark):
    ids = spark.range(20_000)
    table = ids.selectExpr("1e9 + id * 1e-5 AS tight", "CAST(id AS DOUBLE) AS id", "id % 7 AS m", "1.7e15 + id AS big", "5.0 AS flat")
    found = {(r.var_x, r.var_y): r.corr for r in corr_matrix(table, table.columns).collect()}
    for (a, b), value in found.items():
        pair = corr_pair(table, a, b).first().corr
        assert value is None and "flat" in (a, b) if value is None else value == pytest.approx(pair, abs=1e-6)
    assert found["tight", "id"] > 0.999 and found["big", "id"] > 0.999999 and found["id", "flat"] is None


def test_matrix_is_added_up_before_the_shuffle(spark):
    plan = corr_matrix(spark.range(10).selectExpr("id AS a", "id * id AS b"), ["a", "b"])
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1 and "partial_sum" in plan


@pytest.mark.parametrize("statistic, degrees, wanted", [(0.0, 3, 1.0), (3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (1000.0, 2, 7.124576406741286e-218), (50.0, 100, 0.9999932)])
def test_upper_tail(statistic, degrees, wanted):
    assert upper_tail(statistic, degrees) == pytest.approx(wanted, rel=1e-6)
