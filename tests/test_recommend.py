import pytest
from pyspark.sql import Window, functions as F

from impactrec.operators import recommend
from impactrec.operators.recommend import can_be_best
from impactrec.staging import stage


def expected(scores, n=None, per_type=False, kind=None):
    rows = [r for r in scores.collect() if r.prediction in (1.0, 2.0) and kind in (None, r.Type)]
    rows.sort(key=lambda r: ([-p for p in r.probability], r.ID))
    if not per_type:
        return [r.ID for r in rows][:n]
    ranks, out = {}, set()
    for r in rows:
        ranks[r.Type] = ranks.get(r.Type, 0) + 1
        if n is None or ranks[r.Type] <= n:
            out.add((r.Type, ranks[r.Type], r.ID))
    return out


def test_order_by_probability(scores):
    assert [r.ID for r in recommend(scores, n=20).collect()] == expected(scores, 20)
    assert [r.ID for r in recommend(scores).collect()] == expected(scores)
    assert [r.ID for r in recommend(scores, type="small", n=5).collect()] == expected(scores, 5, kind="small")


def test_order_by_class(scores):
    rows = recommend(scores, by="prediction", n=None).collect()
    assert [(r.prediction, r.ID) for r in rows] == sorted((r.prediction, r.ID) for r in rows)
    assert {r.prediction for r in rows} == {1.0, 2.0}


@pytest.mark.parametrize("n", [1, 3, 1000, 1001, None])
def test_ranks_per_type(scores, n):
    """The same ranks from the windows and from ranges, whatever the limit."""
    found = {(r.Type, r["rank"], r.ID) for r in recommend(scores, n=n, per_type=True).collect()}
    assert found == expected(scores, n, per_type=True)


def test_products_without_a_type_are_ranked_too(scores):
    table = scores.withColumn("Type", F.when(F.col("Type") != "promo", F.col("Type")))
    for n in (2, 2000):
        rows = recommend(table, n=n, per_type=True).where("Type IS NULL").collect()
        wanted = min(n, len(expected(scores, kind="promo")))
        assert sorted(r["rank"] for r in rows) == list(range(1, wanted + 1))


def test_other_classes(scores):
    rows = recommend(scores, classes=[4], n=None).collect()
    assert len(rows) == scores.where("prediction = 4").count()


def test_a_frequent_type_is_cut_before_the_shuffle(scores):
    plan = recommend(scores, n=5, per_type=True)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "pmod(xxhash64(ID" in plan
    shown = recommend(scores, n=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in shown


def test_few_rows_are_ranked_where_n_is_large(spark):
    """Of 400,000 rows of a type, little more than the 2,000 best are shuffled; ties, NaN and NULL scores keep their places."""
    score = F.when(F.col("id") % 1000 == 7, F.lit(None)).when(F.col("id") % 100_000 == 9, F.lit(float("nan"))).otherwise(F.floor(F.rand(3) * 100_000) / 100_000)
    rows = spark.range(400_000).select(
        F.col("id").alias("ID"), F.when(F.col("id") % 40 < 38, "hot").when(F.col("id") % 40 == 38, "rare").alias("Type"),
        F.array(F.lit(0.0), score, F.rand(4)).alias("probability"), F.lit(1).alias("EI"), F.lit(1.0).alias("prediction"),
    )
    rows = stage(rows)
    narrow = rows.select("ID", "Type", "probability", "EI")
    kept = {r.Type: r["count"] for r in can_be_best(narrow, 2000).groupBy("Type").count().collect()}
    assert 2000 <= kept["hot"] < 0.02 * 380_000 and kept["rare"] <= 10_000 and kept[None] <= 10_000
    order = Window.partitionBy("Type").orderBy(F.desc("probability"), "ID")
    wanted = narrow.withColumn("rank", F.row_number().over(order)).where("rank <= 2000")
    found = recommend(rows, n=2000, per_type=True)
    assert found.count() == 6000
    assert found.select("ID", "rank").exceptAll(wanted.select("ID", "rank")).isEmpty()


def test_scores_that_no_bound_divides(spark):
    """One score for all, and classes in place of scores."""
    rows = spark.range(5000).select(
        F.col("id").alias("ID"), F.lit("one").alias("Type"), F.array(F.lit(0.5)).alias("probability"), F.lit(1).alias("EI"),
        F.when(F.col("id") % 10 == 0, 1.0).otherwise(2.0).alias("prediction"),
    )
    assert [r.ID for r in recommend(rows, n=1500, per_type=True).orderBy("rank").collect()] == list(range(1500))
    best = [r.ID for r in recommend(rows, by="prediction", n=1200, per_type=True).orderBy("rank").collect()]
    assert best == [*range(0, 5000, 10), *[i for i in range(5000) if i % 10][:700]]
