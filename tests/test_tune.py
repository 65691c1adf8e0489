import pytest
from pyspark.sql import functions as F

from impactrec.operators import DEFAULT_SPACE, classification_metrics, sample_space, score, split_by_key, train
from impactrec.plans.workflows import prepare, tune
from impactrec.staging import stage

SMALL_SPACE = {
    "numTrees": (2, 5), "maxDepth": (1, 6), "maxBins": (16, 64),
    "featureSubsetStrategy": ["all", "sqrt"], "minInfoGain": (0.0, 0.1),
}


def test_sampling_stays_in_the_space():
    drawn = sample_space(DEFAULT_SPACE, 200, 1)
    assert drawn == sample_space(DEFAULT_SPACE, 200, 1) != sample_space(DEFAULT_SPACE, 200, 2)
    for settings in drawn:
        assert set(settings) == set(DEFAULT_SPACE)
        for name, choice in DEFAULT_SPACE.items():
            value = settings[name]
            if isinstance(choice, list):
                assert value in choice
            else:
                assert choice[0] <= value <= choice[1] and type(value) is type(choice[0])
    assert {s["featureSubsetStrategy"] for s in drawn} == {"auto", "all", "sqrt", "log2"}


def test_search_and_refit(noisy):
    prepared = prepare(noisy)
    first = tune(prepared, SMALL_SPACE, n=4, seed=7)
    trials = {r.trial: r for r in first.search.trials.collect()}
    assert len(trials) == 4
    best = max(trials.values(), key=lambda r: (r.accuracy, -r.trial))
    assert {k: best[k] for k in SMALL_SPACE} == pytest.approx(first.search.best) or all(
        best[k] == v for k, v in first.search.best.items()
    )
    # What the search found is kept, the subset strategy included.
    fitted = first.model.stages[-1]
    assert fitted.getFeatureSubsetStrategy() == first.search.best["featureSubsetStrategy"]
    assert fitted.getNumTrees == first.search.best["numTrees"]
    assert classification_metrics(first.held_out).first().accuracy > 0.4
    again = tune(prepared, SMALL_SPACE, n=4, parallelism=1, seed=7)
    assert {r.trial: r.accuracy for r in again.search.trials.collect()} == {k: v.accuracy for k, v in trials.items()}


def test_parts_do_not_overlap(noisy):
    from impactrec.operators import split_by_key

    parts = [{r.ID for r in p.select("ID").collect()} for p in split_by_key(noisy, weights=(0.6, 0.2, 0.2))]
    assert not parts[0] & parts[1] and not parts[1] & parts[2] and not parts[0] & parts[2]


@pytest.fixture(scope="module")
def made(spark):
    """Rows whose type "late" is in the last two parts of the search alone, and tells their class."""
    ids = spark.range(600).withColumnRenamed("id", "ID")
    parts = [p.withColumn("part", F.lit(i)) for i, p in enumerate(split_by_key(ids, weights=(0.6, 0.2, 0.2)))]
    late = (F.col("part") > 0) & (F.col("ID") % 4 == 0)
    rows = parts[0].union(parts[1]).union(parts[2]).select(
        "ID", F.when(late, "late").otherwise(F.concat(F.lit("t"), F.col("ID") % 3)).alias("Type"),
        (F.col("ID") * 7 % 31 / 31.0).alias("Cotton"), (F.col("ID") * 11 % 17 / 17.0).alias("Polyester"),
        F.when(late, 5).when(F.col("ID") % 10 == 0, 3).otherwise(1 + (F.col("ID") * 7 % 31 / 8).cast("int")).alias("EI"),
        "part",
    )
    staged = stage(rows)
    return staged.drop("part"), [staged.where(F.col("part") == i).drop("part") for i in range(3)]


def test_every_trial_has_settings_and_a_forest_of_its_own(made):
    rows, (train_part, valid, _) = made
    space = {"numTrees": (2, 9), "maxDepth": (1, 6), "minInfoGain": (0.0, 0.05), "subsamplingRate": (0.5, 1.0)}
    trials = sorted(tune(rows, space, n=5, seed=42).search.trials.collect())
    assert [{c: t[c] for c in space} for t in trials] == sample_space(space, 5, 42)
    for t in trials:
        model = train(train_part, "rf", {c: t[c] for c in space}, 42)
        assert t.accuracy == classification_metrics(score(model, valid)).first().accuracy


def test_refit_knows_the_categories_of_both_parts(made):
    rows, (train_part, valid, test) = made
    found = tune(rows, {"numTrees": (3, 6), "maxDepth": (2, 4)}, n=2)
    late = test.where("Type = 'late'").count()
    assert late > 0 and found.held_out.count() == test.count()
    assert found.held_out.where("Type = 'late'").count() == late
    again = train(train_part.unionByName(valid), "rf", found.search.best, 42)
    assert classification_metrics(found.held_out).first() == classification_metrics(score(again, test)).first()
