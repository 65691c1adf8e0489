"""All steps on a table of the full product shape, read from CSV."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impactrec import operators as ops
from impactrec.plans import workflows
from impactrec.sources import PRODUCT_SCHEMA, UNUSED_MATERIALS, numeric_columns, read_products
from impactrec.staging import stage

PLACES = ["Africa", "America", "Asia", "Europe", "NaN", None]
WASHING = ["Machine wash_ hot", "Machine wash_ warm", "Machine wash_ cold", "Hand wash", "Dry clean"]
DRYING = ["Line dry", "Dry clean", "Tumble dry_ low", "Tumble dry_ high", None]
TYPES = ["jacket", "jeans", "blouse", "shirt", "jacket", "jacket"]


def pick(values, step):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("ID") * step % len(values) + 1).cast("int"))


@pytest.fixture(scope="module")
def products(spark, tmp_path_factory):
    """A third of the rows share a type; the class follows two materials and the distance."""
    base = spark.range(600).withColumnRenamed("id", "ID")
    made = {}
    for i, field in enumerate(PRODUCT_SCHEMA):
        mixed = F.pmod(F.xxhash64("ID", F.lit(i)), F.lit(101))
        if isinstance(field.dataType, T.DoubleType):
            made[field.name] = mixed / 100
        elif isinstance(field.dataType, T.IntegerType):
            made[field.name] = (mixed % 4).cast("int")
    made |= {
        "Type": pick(TYPES, 1), "Manufacturing_location": pick(PLACES, 5),
        "Washing_instruction": pick(WASHING, 3), "Drying_instruction": pick(DRYING, 7),
        "Use_location": pick(["Europe", "Asia"], 1),
    }
    table = base.select("ID", *[v.alias(k) for k, v in made.items()])
    score = F.col("Cotton") + F.col("Polyester") + F.col("Transporation_distance")
    table = table.withColumn("EI", F.least(F.floor(score * 5 / 3) + 1, F.lit(5)).cast("int"))
    path = str(tmp_path_factory.mktemp("products") / "csv")
    table.select(*PRODUCT_SCHEMA.names).write.option("header", True).csv(path)
    return stage(read_products(spark, path))


def test_shape(products):
    assert products.schema == PRODUCT_SCHEMA and products.count() == 600
    assert len(numeric_columns(products)) == 37
    assert len(numeric_columns(products.drop(*UNUSED_MATERIALS))) == 31


def test_profile_and_duplicates(products):
    assert ops.duplicate_rows(products).count() == 0
    twice = products.union(products.where("ID < 10"))
    assert ops.duplicate_rows(twice).count() == 10
    assert ops.profile(products).count() == len(PRODUCT_SCHEMA)


def test_correlation_of_every_pair(products):
    names = numeric_columns(products)
    matrix = ops.corr_matrix(products, names)
    assert matrix.count() == 37 * 36
    label = matrix.where("var_x = 'EI'").orderBy(F.col("corr").desc()).limit(3).collect()
    assert {r.var_y for r in label} == {"Cotton", "Polyester", "Transporation_distance"}


@pytest.mark.parametrize("encoded, width", [(False, 36), (True, 45)])
def test_components_with_the_label(products, encoded, width):
    table = ops.encode_rules(products) if encoded else products
    inputs, names = ops.pca_inputs(table.drop(*UNUSED_MATERIALS), exclude=("ID",))
    assert len(names) == width
    found = ops.pca(inputs, names, width)
    assert found.variance.agg(F.sum("ratio")).first()[0] == pytest.approx(1.0)
    assert found.loadings.count() == width * width
    assert 1 < ops.components_for(found.variance).first().k <= width


def test_selection(products):
    names = ops.select_features(products, bins=5).names
    assert len(names) == 15
    assert {"Cotton_binned", "Polyester_binned", "Transporation_distance_binned"} <= set(names)


@pytest.mark.parametrize("feature_set, inputs", [("full", 44), ("core_materials", 26), ("no_drying", 41)])
def test_feature_sets_reach_the_model(products, feature_set, inputs):
    prepared = workflows.prepare(products, feature_set)
    trained = workflows.train_on(prepared, "dt", {"maxDepth": 3})
    assert ops.importances(trained.model, prepared).count() == inputs


def test_train_evaluate_recommend(products):
    prepared = workflows.prepare(products)
    for algo, params in (("dt", {}), ("rf", {"numTrees": 10}), ("ovr_gbt", {"maxIter": 3, "maxDepth": 4})):
        trained = workflows.train_on(prepared, algo, params)
        result = workflows.evaluate(trained.held_out)
        assert result.summary.first().accuracy > 0.4
        assert result.mean_area.first().mean_auc > 0.6
        jackets = workflows.recommend_from(trained, type="jacket").collect()
        assert jackets and all(r.Type == "jacket" for r in jackets)
        ranked = workflows.recommend_from(trained, n=3, per_type=True)
        assert ranked.groupBy("Type").count().agg(F.max("count")).first()[0] <= 3
