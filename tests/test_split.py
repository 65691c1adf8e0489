import pytest
from pyspark.sql import functions as F

from impactrec.operators import split_by_key, split_random


def keys(table):
    return {r.ID for r in table.select("ID").collect()}


@pytest.mark.parametrize("weights", [(0.8, 0.2), (0.6, 0.2, 0.2), (1, 1)])
def test_parts_are_disjoint_complete_and_stable(products, weights):
    parts = [keys(p) for p in split_by_key(products, weights=weights)]
    assert sum(len(p) for p in parts) == 2000 and set().union(*parts) == keys(products)
    again = [keys(p) for p in split_by_key(products.repartition(23, F.rand()), weights=weights)]
    assert parts == again
    for part, weight in zip(parts, weights):
        assert len(part) / 2000 == pytest.approx(weight / sum(weights), abs=0.05)


def test_seed_changes_the_parts(products):
    assert keys(split_by_key(products, seed=1)[0]) != keys(split_by_key(products, seed=2)[0])


def test_random_split_is_complete(products):
    train, test = split_random(products)
    assert train.count() + test.count() == 2000


def test_splitting_is_a_filter(products):
    plan = split_by_key(products)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_small_parts_are_not_rounded_away(spark):
    rows = spark.range(100_000).withColumnRenamed("id", "ID")
    sizes = [p.count() for p in split_by_key(rows, weights=(0.996, 0.004))]
    assert sum(sizes) == 100_000 and 300 < sizes[1] < 500
