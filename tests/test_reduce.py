import numpy as np
import pytest
from pyspark.sql import functions as F

from impactrec.operators import components_for, cumulative_variance, encode_rules, pca, pca_inputs, select_features
from impactrec.operators.reduce import feature_pipeline


@pytest.fixture(scope="module")
def parts(products):
    table, cols = pca_inputs(encode_rules(products))
    return table, cols, pca(table, cols)


def test_inputs_leave_out_key_and_label(parts):
    assert parts[1][:2] == ["Type_index", "Use_location_index"]
    assert not {"ID", "EI"} & set(parts[1])


def test_against_numpy(parts):
    table, cols, found = parts
    data = np.array([[float(v) for v in r] for r in table.select(*cols).collect()])
    expected = np.linalg.eigvalsh(np.corrcoef(data.T))[::-1] / len(cols)
    ratios = [r.ratio for r in found.variance.orderBy("component").collect()]
    assert ratios == pytest.approx(expected.tolist(), abs=1e-9)


def test_loadings_are_orthonormal_and_named(parts):
    _, cols, found = parts
    rows = found.loadings.collect()
    size = len(cols)
    weights = np.zeros((size, size))
    for r in rows:
        weights[r.component - 1, cols.index(r.feature)] = r.loading
    assert np.allclose(weights @ weights.T, np.eye(size), atol=1e-8)


def test_a_loading_belongs_to_its_feature(spark):
    """Two columns move together and one alone, so the first component must weigh the two."""
    rows = [(float(i % 17), float(i % 17), float((i * 7) % 11)) for i in range(187)]
    table = spark.createDataFrame(rows, "a double, b double, c double")
    found = pca(table, ["a", "b", "c"])
    first = {r.feature: abs(r.loading) for r in found.loadings.where("component = 1").collect()}
    assert first["a"] == pytest.approx(first["b"]) and first["c"] < 0.1 < first["a"]
    assert "pca_features" in found.scores.columns and found.scores.count() == 187


def test_components_needed(spark):
    table = spark.createDataFrame([(1, 0.7), (2, 0.2), (3, 0.06), (4, 0.04)], "component int, ratio double")
    variance = cumulative_variance(table)
    assert components_for(variance, 0.95).first().k == 3
    assert components_for(variance, 0.7).first().k == 1
    assert components_for(variance, 1.01).first().k is None


def test_selected_names_cover_encoded_slots(spark):
    rows = [(i, "good" if i % 5 < 2 else "bad", float(i % 3), 1 if i % 5 < 2 else 2) for i in range(300)]
    table = spark.createDataFrame(rows, "ID int, Type string, noise double, EI int")
    selection = select_features(table, k=2)
    assert set(selection.names) == {"Type_encoded_bad", "Type_encoded_good"}
    assert selection.table.select("selectedFeatures").first()[0].size == 2


def test_continuous_columns_can_be_binned(products):
    table = products.withColumn("fine", F.col("ID") / 7.0)
    model = feature_pipeline(table, [], ["fine", "Cotton"], bins=10, k=1).fit(table)
    assert model.stages[-1].selectedFeatures == [1]


def test_pipeline_without_encoding_or_selection(products):
    model = feature_pipeline(products, ["Type"], ["Cotton"], encode=False, k=None).fit(products)
    assert model.transform(products).first().features.size == 2
