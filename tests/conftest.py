from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from impactrec.session import local_session
from impactrec.sources import noisy_products, product_table, score_table
from impactrec.staging import release, stage

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def products(spark):
    return stage(product_table(spark, MEDIUM))


@pytest.fixture(scope="session")
def noisy(products):
    return noisy_products(products)


@pytest.fixture(scope="session")
def scores(products):
    return stage(score_table(products))
