"""Trees as tables, and votes of the first trees of a forest, against the models themselves."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from impactrec.operators import decision_paths, leaf_paths, prefix_predictions, score, train, tree_nodes, tune_folds, tune_random
from impactrec.operators.models import bins_needed, fit_classifier
from impactrec.operators.tune import shared_fits
from impactrec.staging import stage

INPUTS = ["ID", "Type", "Cotton", "Polyester", "Washing_instruction", "EI"]


@pytest.fixture(scope="module")
def rows(noisy):
    return stage(noisy.select(*INPUTS).where("Washing_instruction <> 'Hand wash' OR ID % 3 = 0"))


@pytest.fixture(scope="module")
def forest(rows):
    return train(rows, "rf", dict(numTrees=6, maxDepth=4))


def test_nodes_of_a_tree(spark, rows):
    model = train(rows, "dt", dict(maxDepth=4))
    fitted = model.stages[-1]
    nodes = {r.node: r for r in tree_nodes(model, spark).collect()}
    assert len(nodes) == fitted.numNodes
    roots = [r for r in nodes.values() if r.parent is None]
    assert len(roots) == 1 and roots[0]["rows"] == rows.count()
    for r in nodes.values():
        below = [x for x in nodes.values() if x.parent == r.node]
        assert len(below) == (0 if r.feature is None else 2) and (r.leaf is None) == bool(below)
        if below:
            assert sorted(x.side for x in below) == ["left", "right"] and sum(x["rows"] for x in below) == r["rows"]
            assert (r.threshold is None) != (r.categories is None) and r.gain > 0
    named = {c for r in nodes.values() for c in r.categories or ()}
    assert named <= {v[0] for c in ("Type", "Washing_instruction") for v in rows.select(c).distinct().collect()}


def test_paths_lead_to_the_models_predictions(spark, rows, forest):
    tree = train(rows, "dt", dict(maxDepth=5))
    found = {r.ID: r for r in decision_paths(tree, rows).collect()}
    scored = {r.ID: r.prediction for r in score(tree, rows).select("ID", "prediction").collect()}
    assert {i: r.prediction for i, r in found.items()} == scored
    # Every condition of a path holds for its product.
    sample = {r.ID: r for r in rows.limit(50).collect()}
    for i, product in sample.items():
        for step in found[i].path.split(" AND ") if found[i].path else []:
            name, rest = step.split(" ", 1)
            value = product[name]
            if rest.startswith(("<=", ">")):
                sign, border = rest.split(" ")
                assert (value <= float(border)) == (sign == "<=")
            else:
                inside = value in rest[rest.index("(") + 1 : -1].split(", ")
                assert inside == rest.startswith("in")
    of_forest = decision_paths(forest, rows)
    assert of_forest.count() == 6 * rows.count()
    assert leaf_paths(forest, spark).groupBy("tree").agg(F.sum("rows")).count() == 6


def test_prefixes_are_the_votes_of_the_first_trees(rows, forest):
    sizes = [1, 3, 6]
    found = {r.ID: r.predictions for r in prefix_predictions(forest, rows, sizes, ["ID"]).collect()}
    whole = {r.ID: r.prediction for r in score(forest, rows).select("ID", "prediction").collect()}
    assert {i: p[2] for i, p in found.items()} == whole
    # Each tree scores by itself, and its shares of classes are added up.
    trees = forest.stages[-1].trees
    ready = forest.stages[0:-1]
    table = rows
    for s in ready:
        table = s.transform(table)
    votes = {}
    for tree in trees[:3]:
        tree.setProbabilityCol("own_share").setRawPredictionCol("own_raw").setPredictionCol("own")
        for r in tree.transform(table).select("ID", "own_share").collect():
            votes.setdefault(r.ID, []).append(r.own_share.toArray())
    for i, shares in votes.items():
        assert found[i][0] == float(shares[0].argmax())
        assert found[i][1] == float(sum(shares).argmax())
    with pytest.raises(ValueError, match="between 1 and 6"):
        prefix_predictions(forest, rows, [7], ["ID"])


def test_trials_that_share_a_forest(rows):
    settings = [{"numTrees": n, "maxDepth": n} for n in (4, 2, 9, 5)]
    assert shared_fits(settings, 3) == [[0, 1, 2], [3]]
    assert settings == [{"numTrees": 4, "maxDepth": 4}, {"numTrees": 2, "maxDepth": 4}, {"numTrees": 9, "maxDepth": 4}, {"numTrees": 5, "maxDepth": 5}]
    train_part, valid = rows.where("ID % 4 <> 0"), rows.where("ID % 4 = 0")
    space = {"numTrees": (2, 8), "maxDepth": (2, 5)}
    search = tune_random(train_part, valid, space, n=4, seed=3)
    trials = search.trials.collect()
    assert len({t.maxDepth for t in trials[:3]}) == 1
    largest = max(t.numTrees for t in trials[:3])
    vectors = stage(search.features.transform(train_part).select("features", "EI"))
    fitted = fit_classifier(vectors, "rf", {"numTrees": largest, "maxDepth": trials[0].maxDepth}, 3, "EI", bins_needed(search.features))
    forest = PipelineModel([*search.features.stages, *fitted])
    cut = prefix_predictions(forest, valid, [t.numTrees for t in trials[:3]], ["EI"])
    shares = cut.agg(*[F.avg((F.get("predictions", i) == F.col("EI")).cast("int")) for i in range(3)]).first()
    assert [t.accuracy for t in trials[:3]] == pytest.approx(list(shares))


def test_folds(rows):
    found = tune_folds(rows, {"numTrees": (2, 4), "maxDepth": (2, 4)}, n=2, folds=3, seed=5)
    cells = found.folds.collect()
    assert sorted((r.trial, r.fold) for r in cells) == [(t, f) for t in (0, 1) for f in (0, 1, 2)]
    assert sum(r.n_rows for r in cells if r.trial == 0) == rows.count()
    for t in found.search.trials.collect():
        shares = [r.n_hits / r.n_rows for r in cells if r.trial == t.trial]
        assert t.accuracy == pytest.approx(sum(shares) / 3)
        assert t.spread == pytest.approx((sum((x - t.accuracy) ** 2 for x in shares) / 2) ** 0.5)
    assert found.search.rows.count() == rows.count()


def test_votes_of_many_trees_take_no_more_room():
    """Running sums are as after every tree, with the same rounding, and their memory does not grow with the trees."""
    import tracemalloc

    import numpy as np

    from impactrec.operators import trees

    source = np.random.default_rng(4)
    tables = [source.dirichlet(np.ones(5), 40) for _ in range(90)]
    leaves = source.integers(0, 40, (5000, 90))
    wanted = np.array([89, 0, 17, 17])
    expected = np.cumsum(np.stack([t[leaves[:, i]] for i, t in enumerate(tables)], 1), axis=1)[:, wanted].argmax(2)
    tracemalloc.start()
    found = trees._prefix_classes(leaves, tables, wanted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == expected).all() and peak < 10 * 5000 * 5 * 8
