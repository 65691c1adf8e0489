"""Every registered query against its SQL, and the rest for rows."""

import pytest
from compare import differences, duck
from conftest import SMALL

from impactrec.plans.oracle import oracle_queries
from impactrec.plans.queries import all_queries

ORACLE = oracle_queries()
ROWS_ONLY = sorted(set(all_queries()) - set(ORACLE) - {"tune_random_search", "best_model_metrics"})


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert differences(all_queries()[name](spark, SMALL), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_returns_rows(spark, name):
    assert all_queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    table = contract.entry(spark)
    assert table.columns == ["ID", "Type", "EI", "p1", "p2", "p3", "p4", "p5"]
    assert table.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
