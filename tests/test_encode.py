import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from impactrec.operators import (
    DEFAULT_RULES,
    Rule,
    assemble,
    encode_rules,
    expand_slots,
    index_strings,
    one_hot,
    scale,
    string_indexer,
)

SOURCES = "Manufacturing_location string, Drying_instruction string, Washing_instruction string"


def encoded(spark, location, drying, washing):
    row = encode_rules(spark.createDataFrame([(location, drying, washing)], SOURCES)).first().asDict()
    return {k for k, v in row.items() if v == 1}


@pytest.mark.parametrize(
    "values, expected",
    [
        (("Asia", "Line dry", "Machine wash_ hot"),
         {"Manufacturing_location_Asia", "Drying_instruction_Linedry", "Washing_instruction_Machinehot"}),
        (("NaN", "Tumble dry_ low", "Machine wash_ warm"),
         {"Manufacturing_location_Unknown", "Drying_instruction_Tumble", "Washing_instruction_Machinehot"}),
        ((None, None, None), {"Manufacturing_location_Unknown"}),
        (("Europe", "Tumble dry_ medium", "Dry clean"),
         {"Manufacturing_location_Europe", "Washing_instruction_Dryclean"}),
        (("Antarctica", "Dry clean", "Hand wash"), {"Drying_instruction_Dryclean", "Washing_instruction_Handwash"}),
    ],
)
def test_rules(spark, values, expected):
    assert encoded(spark, *values) == expected


def test_dummies_of_one_source_exclude_each_other(products):
    table = encode_rules(products)
    for source in {r.source for r in DEFAULT_RULES}:
        total = sum(F.col(r.output) for r in DEFAULT_RULES if r.source == source)
        assert table.agg(F.max(total)).first()[0] <= 1
    assert "Manufacturing_location" not in table.columns
    assert "Manufacturing_location" in encode_rules(products, drop_source=False).columns


def test_a_rule_can_be_added(products):
    rule = Rule("Drying_medium", "Drying_instruction", ("Tumble dry_ medium",))
    table = encode_rules(products, [*DEFAULT_RULES, rule])
    assert table.agg(F.sum("Drying_medium")).first()[0] > 0


def test_index_order_and_invalid_values(spark):
    fit = spark.createDataFrame([(v,) for v in ["b", "b", "c", "a", "a", "d", None]], "t string")
    other = spark.createDataFrame([("a",), ("new",), (None,)], "t string")
    kept = string_indexer(fit, ["t"], "keep").transform(other)
    assert {r.t: r.t_index for r in kept.collect()} == {"a": 0.0, "new": 4.0, None: 4.0}
    skipped = string_indexer(fit, ["t"], "skip").transform(other)
    assert [(r.t, r.t_index) for r in skipped.collect()] == [("a", 0.0)]
    order = {r.t: r.t_index for r in index_strings(fit, ["t"]).collect()}
    assert order == {"a": 0.0, "b": 1.0, "c": 2.0, "d": 3.0}


def test_index_agrees_with_the_estimator(products):
    cols = ["Type", "Manufacturing_location", "Drying_instruction"]
    estimator = StringIndexer(inputCols=cols, outputCols=[f"{c}_index" for c in cols], handleInvalid="keep")
    assert estimator.fit(products).labelsArray == [s.labels for s in string_indexer(products, cols).stages]


def test_free_text_is_not_collected(spark):
    table = spark.range(300).select(F.col("id").cast("string").alias("t"), (F.col("id") % 3).cast("string").alias("u"))
    with pytest.raises(ValueError, match="more than 100 categories: t"):
        string_indexer(table, ["t", "u"], max_categories=100)
    assert len(string_indexer(table, ["t", "u"], max_categories=300).stages[0].labels) == 300


def test_one_hot_has_a_slot_per_value(spark):
    table = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    rows = {r.t: r for r in expand_slots(one_hot(table, ["t"]), "t_encoded").collect()}
    assert (rows["a"]["t_encoded_a"], rows["a"]["t_encoded_b"]) == (1.0, 0.0)
    assert (rows[None]["t_encoded_a"], rows[None]["t_encoded_b"]) == (0.0, 0.0)


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_assembling_a_gap_is_an_error(spark, bad):
    table = spark.createDataFrame([(1.0, 2.0), (1.0, bad)], "a double, b double")
    with pytest.raises(Exception):
        assemble(table, ["a", "b"]).collect()
    assert assemble(table, ["a", "b"], handle_invalid="skip").count() == 1


def test_scaling(spark):
    table = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = scale(table, ["a", "b"]).select(vector_to_array("scaled_features").alias("v")).collect()
    root = 2**0.5
    assert sorted(r.v for r in rows) == [pytest.approx([1 / root, 0.0]), pytest.approx([3 / root, 0.0])]
