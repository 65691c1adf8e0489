import pytest
from pyspark.sql import functions as F

from impactrec.operators import (
    aligned_scores,
    classification_metrics,
    encode_rules,
    importances,
    model_stages,
    score,
    skipped_rows,
    train,
)
from impactrec.operators.models import classifier
from impactrec.plans.workflows import evaluate, prepare, recommend_from, train_on

FAST = {"dt": {}, "rf": {"numTrees": 10}, "ovr_gbt": {"maxIter": 5}}


@pytest.fixture(scope="module")
def prepared(noisy):
    return prepare(noisy)


@pytest.fixture(scope="module")
def trained(prepared):
    return {algo: train_on(prepared, algo, params) for algo, params in FAST.items()}


@pytest.mark.parametrize("algo", sorted(FAST))
def test_beats_the_majority_class(trained, algo):
    held_out = trained[algo].held_out
    majority = held_out.groupBy("EI").count().agg(F.max("count")).first()[0] / held_out.count()
    result = evaluate(held_out)
    assert result.summary.first().accuracy > majority + 0.3
    mean = result.mean_area.first()
    assert mean.n_classes == 5 and 0.8 < mean.mean_auc <= 1


@pytest.mark.parametrize("algo", sorted(FAST))
def test_same_seed_same_predictions(prepared, trained, algo):
    def predictions(model):
        return sorted(map(tuple, score(model, prepared).select("ID", "prediction").collect()))

    again = train_on(prepared, algo, FAST[algo]).model
    assert predictions(again) == predictions(trained[algo].model)


@pytest.mark.parametrize("algo", sorted(FAST))
def test_recommendations_are_in_the_best_classes(trained, algo):
    rows = recommend_from(trained[algo], type="promo", n=20).collect()
    assert 0 < len(rows) <= 20 and all(r.Type == "promo" for r in rows)


def test_boosting_trains_no_model_for_an_absent_class(prepared, trained):
    stage = trained["ovr_gbt"].model.stages[-2]
    assert len(stage.models) == 5
    scored = score(trained["ovr_gbt"].model, prepared)
    assert {r[0] for r in scored.select("prediction").distinct().collect()} <= {1.0, 2.0, 3.0, 4.0, 5.0}
    slots = aligned_scores(scored, [1, 2, 3, 4, 5]).select("class_scores", "prediction").collect()
    for row in slots[:200]:
        assert row.class_scores[0] is None
        assert max(range(1, 6), key=lambda k: row.class_scores[k]) == row.prediction


def test_classes_need_not_be_contiguous(products):
    table = products.select("ID", "Cotton", (F.col("EI") * 3).alias("EI"))
    found = score(train(table, "ovr_gbt", {"maxIter": 2, "maxBins": 64}), table)
    assert classification_metrics(found).first().accuracy == 1.0


def test_products_without_a_label_can_be_scored(prepared, trained):
    for algo in FAST:
        assert score(trained[algo].model, prepared.drop("EI")).count() == 2000


def test_settings_are_the_published_ones():
    forest = classifier("rf", None, 1, "EI")
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMaxBins()) == (50, 15, 30)
    tree = classifier("dt", None, 1, "EI")
    assert (tree.getMaxDepth(), tree.getImpurity(), tree.getMinInfoGain()) == (20, "entropy", 0.01)
    boosted = classifier("ovr_gbt", {"maxIter": 3}, 1, "EI")
    assert (boosted.getMaxIter(), boosted.getStepSize(), boosted.getSeed()) == (3, 0.2, 1)
    drawn = classifier("rf", {"numTrees": 17.9, "maxDepth": 6.0, "minInfoGain": 0.05}, 1, "EI")
    assert (drawn.getNumTrees(), drawn.getMaxDepth(), drawn.getMinInfoGain()) == (17, 6, 0.05)
    with pytest.raises(ValueError):
        classifier("svm", None, 1, "EI")


def test_bins_grow_with_the_categories(spark):
    rows = [(i, f"t{i % 40}", 1 + i % 2) for i in range(400)]
    table = spark.createDataFrame(rows, "ID int, t string, EI int")
    model = train(table, "dt", {"maxBins": 8})
    assert model.stages[-1].getMaxBins() == 40
    assert score(model, table).count() == 400


def test_feature_mode_changes_the_inputs(prepared):
    everything = model_stages(train(prepared, "dt", {"maxDepth": 2}), prepared)
    doubles = model_stages(train(prepared, "dt", {"maxDepth": 2}, feature_mode="double_only"), prepared)
    both = [{r.input_column for r in t.where("stage = 'VectorAssembler'").collect()} for t in (everything, doubles)]
    assert both[1] < both[0]
    assert "Manufacturing_location_Asia" in both[0] - both[1]


def test_feature_sets_change_the_inputs(noisy):
    names = [set(prepare(noisy, s).columns) for s in ("full", "no_drying")]
    assert names[0] - names[1] == {"Drying_instruction_Linedry", "Drying_instruction_Dryclean", "Drying_instruction_Tumble"}


def test_skipped_rows_are_reported(products):
    table = products.select("ID", "Cotton", "Drying_instruction", "EI")
    model = train(table.where("Drying_instruction != 'Line dry'"), "dt", {"maxDepth": 2})
    row = skipped_rows(model, table).first()
    assert row.n_rows == 2000
    assert row.n_skipped == table.where("Drying_instruction IS NULL OR Drying_instruction = 'Line dry'").count()
    assert score(model, table).count() == row.n_rows - row.n_skipped
    kept = train(table, "dt", {"maxDepth": 2}, handle_invalid="keep")
    assert score(kept, table).count() == 2000 and skipped_rows(kept, table).first().n_skipped == 0


def test_importances(trained, prepared):
    rows = importances(trained["dt"].model, prepared).collect()
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    assert rows[0].feature == "Cotton" and len(rows) == 20
    assert importances(trained["rf"].model, prepared, 3).count() == 3
    with pytest.raises(ValueError):
        importances(trained["ovr_gbt"].model, prepared)


def test_encoding_is_what_training_sees(products):
    encoded = encode_rules(products)
    model = train(encoded, "dt", {"maxBins": 64})
    assert classification_metrics(score(model, encoded)).first().accuracy == 1.0
