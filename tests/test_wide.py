"""Sparse vectors of any number of values, and components of wide tables."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from impactrec.operators import assemble, one_hot, pca, pca_wide, sparse_features
from impactrec.operators import sparse as sparse_module


def _values(table, key="ID", column="features"):
    return {r[0]: list(r[1]) for r in table.select(key, vector_to_array(F.col(column)).alias("v")).collect()}


@pytest.mark.parametrize("frequent", [0, 2, 1000])
def test_sparse_slots_are_those_of_a_fitted_encoder(spark, products, frequent, monkeypatch):
    monkeypatch.setattr(sparse_module, "FREQUENT_VALUES", frequent)
    cols = ["Type", "Drying_instruction"]
    table = products.select("ID", *cols, "Cotton")
    found = sparse_features(table, cols, ["Cotton"])
    fitted = assemble(one_hot(table, cols), ["Type_encoded", "Drying_instruction_encoded", "Cotton"])
    assert _values(found.table) == _values(fitted)
    slots = {r.position: (r.feature, r.value) for r in found.slots.collect()}
    assert len(slots) == found.size and slots[found.size - 1] == ("Cotton", None)
    assert slots[0][0] == "Type"


def test_too_many_categories_for_a_model_are_refused(spark):
    from impactrec.operators import models

    table = spark.range(30).selectExpr("id ID", "concat('v', id) name", "int(id % 2) EI")
    with pytest.raises(ValueError, match="sparse_features"):
        one_hot(table, ["name"], max_categories=29)
    with pytest.raises(ValueError, match="sparse_features"):
        models.feature_model(table, max_categories=29)
    assert one_hot(table, ["name"], max_categories=30).count() == 30
    assert sparse_features(table, ["name"]).size == 30


def test_missing_values_empty_tables_and_repeated_rows(spark):
    shape = "ID long, name string, size double, features_of string"
    rows = [(1, "a", 2.0, "x"), (1, "a", 2.0, "x"), (2, None, None, "x"), (3, "", float("nan"), None), (4, "b", 0.0, "x")]
    found = sparse_features(spark.createDataFrame(rows, shape), ["name", "features_of"], ["size"])
    cells = [(r.ID, r.features["indices"]) for r in found.cells.orderBy("ID").collect()]
    assert [c[0] for c in cells] == [1, 1, 2, 3, 4] and cells[0] == cells[1]
    # "a" occurs twice, then "" and "b" in value order, then "x", then the number.
    assert cells[0][1] == [0, 3, 4] and cells[2][1] == [3] and cells[3][1] == [1] and cells[4][1] == [2, 3]
    empty = sparse_features(spark.createDataFrame([], shape), ["name"])
    assert empty.size == 0 and empty.table.count() == 0


@pytest.fixture(scope="module")
def sixty(spark):
    """Sixty columns of falling weight, one of them constant, far from zero."""
    source = np.random.default_rng(5)
    data = source.standard_normal((3000, 60)) @ (source.standard_normal((60, 60)) * 0.8 ** np.arange(60)[:, None]) + 100
    data[:, 7] = 3.0
    cols = [f"c{i}" for i in range(60)]
    return spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{c} double" for c in cols)), cols


def test_agrees_with_the_whole_covariance(sixty):
    table, cols = sixty
    exact = pca(table, cols, 5)
    found = pca_wide(assemble(table, cols), "features", 5, names=cols, block=8)
    varied = 59
    weigh = lambda parts: {(r.component, r.feature): r.loading for r in parts.loadings.where("component <= 5").collect()}
    ratio = lambda parts: [r.ratio for r in parts.variance.where("component <= 5").orderBy("component").collect()]
    assert ratio(found) == pytest.approx(ratio(exact), abs=1e-6) and varied == 59
    assert weigh(found) == pytest.approx(weigh(exact), abs=1e-6)
    left = {round(r.c0, 9): list(r.pca_features) for r in found.scores.collect()}
    right = {round(r.c0, 9): list(r.pca_features)[:5] for r in exact.scores.select("c0", "pca_features").collect()}
    assert left.keys() == right.keys()
    assert all(left[k] == pytest.approx(right[k], abs=1e-4) for k in left)


def test_sparse_dense_and_mixed_vectors_agree(spark):
    from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
    from pyspark.sql import types as T

    source = np.random.default_rng(1)
    data = np.where(source.random((400, 12)) < 0.3, source.integers(1, 5, (400, 12)), 0).astype(float)
    data[5] = 0
    shape = T.StructType([T.StructField("row", T.LongType()), T.StructField("v", VectorUDT())])

    def table(kind):
        sparse = lambda r: SparseVector(12, np.flatnonzero(r).tolist(), r[r != 0].tolist())
        dense = lambda r: DenseVector(r.tolist())
        pick = {"sparse": lambda i: sparse, "dense": lambda i: dense, "mixed": lambda i: (sparse, dense)[i % 2]}[kind]
        return spark.createDataFrame([(i, pick(i)(r)) for i, r in enumerate(data)], shape)

    expected = np.linalg.eigvalsh(np.corrcoef(data.T))[::-1] / 12
    for kind in ("sparse", "dense", "mixed"):
        found = pca_wide(table(kind), "v", 4, block=3 if kind == "mixed" else 6)
        assert [r.ratio for r in found.variance.orderBy("component").collect()] == pytest.approx(expected[:4].tolist(), abs=1e-8)
        assert found.scores.columns == ["row", "pca_features"] and found.scores.count() == 400


def test_tables_without_components(spark):
    constant = assemble(spark.createDataFrame([(1.0, 2.0)] * 3, "a double, b double"), ["a", "b"])
    for table in (constant, constant.limit(1), constant.where("a > 5")):
        found = pca_wide(table.select("features"), "features", 2)
        assert found.variance.count() == 0 and found.loadings.count() == 0


def test_too_wide_for_the_driver_is_refused(spark, monkeypatch):
    from impactrec.operators import wide

    monkeypatch.setattr(wide, "DRIVER_NUMBERS", 10)
    with pytest.raises(ValueError, match="driver"):
        pca_wide(assemble(spark.range(5).selectExpr("double(id) a", "double(id % 2) b"), ["a", "b"]).select("features"), "features", 1)


def test_no_null_list_goes_to_python(spark, monkeypatch):
    """Dense vectors have no indices: sent as NULL lists they took most of the time of a pass."""
    from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
    from pyspark.sql import types as T

    shape = T.StructType([T.StructField("row", T.LongType()), T.StructField("v", VectorUDT())])
    vectors = [DenseVector([1.0, 2.0]), SparseVector(2, [1], [3.0]), None, DenseVector([4.0, 0.5]), SparseVector(2, [], [])]
    table = spark.createDataFrame(list(enumerate(vectors)), shape)
    sent, run = [], type(table).mapInArrow
    monkeypatch.setattr(type(table), "mapInArrow", lambda self, *a, **b: sent.append(self) or run(self, *a, **b))
    found = pca_wide(table, "v", 2)
    correlation = np.corrcoef(np.array([[1, 2], [0, 3], [0, 0], [4, 0.5], [0, 0]]).T)
    assert [r.ratio for r in found.variance.orderBy("component").collect()] == pytest.approx((np.linalg.eigvalsh(correlation)[::-1] / 2).tolist())
    assert found.scores.count() == 5 and len(sent) > 2
    for df in sent:
        assert df.where("v IS NULL OR v.type IS NULL OR v.indices IS NULL OR v.values IS NULL").count() == 0
