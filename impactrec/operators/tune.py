"""Random search over model settings, on one validation part or on folds."""

from __future__ import annotations

import random
import statistics
from concurrent.futures import ThreadPoolExecutor
from typing import Any, NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from impactrec.operators.models import bins_needed, class_values, feature_model, fit_classifier, train
from impactrec.operators.split import split_part
from impactrec.operators.trees import prefix_predictions
from impactrec.sources.schema import KEY, LABEL
from impactrec.staging import stage, stage_path

# The published search space. A pair of integers is a range of whole numbers,
# a pair of floats a continuous range, a list a choice.
DEFAULT_SPACE: dict[str, Any] = {
    "numTrees": (10, 100),
    "maxDepth": (5, 20),
    "maxBins": (23, 50),
    "featureSubsetStrategy": ["auto", "all", "sqrt", "log2"],
    "subsamplingRate": (0.5, 1.0),
    "minInstancesPerNode": (1, 10),
    "minInfoGain": (0.0, 0.1),
}
DEFAULT_TRIALS = 50
# Trials that share a forest and differ in its number of trees alone.
DEFAULT_PREFIXES = 3


def sample_space(space: dict[str, Any], n: int, seed: int) -> list[dict[str, Any]]:
    """``n`` settings drawn at random; the same seed draws the same ones."""
    draw = random.Random(seed)

    def one(choice: Any) -> Any:
        if isinstance(choice, list):
            return draw.choice(choice)
        low, high = choice
        return draw.randint(low, high) if isinstance(low, int) else draw.uniform(low, high)

    return [{name: one(choice) for name, choice in space.items()} for _ in range(n)]


class Search(NamedTuple):
    """``features`` and ``rows`` are the fitted feature stages and the vectors of all rows, for the refit."""

    trials: DataFrame
    best: dict[str, Any]
    features: PipelineModel
    rows: DataFrame


def shared_fits(settings: list[dict[str, Any]], prefixes: int) -> list[list[int]]:
    """Groups of trials that differ in ``numTrees`` alone, as indices; the first trial of each gives the other settings."""
    groups = [list(range(i, min(i + prefixes, len(settings)))) for i in range(0, len(settings), prefixes)]
    for first, *others in groups:
        for i in others:
            settings[i] = settings[first] | {"numTrees": settings[i]["numTrees"]}
    return groups


def _hits(
    fit_rows: DataFrame, check_rows: DataFrame, settings: list[dict[str, Any]], algo: str, seed: int, label: str, floor: int, classes: list[int]
) -> list[tuple[int, int]]:
    """Right predictions and rows for each of some settings, which differ in ``numTrees`` alone: one fit."""
    largest = max(settings, key=lambda s: s.get("numTrees", 0))
    model = PipelineModel(fit_classifier(fit_rows, algo, largest, seed, label, floor, classes=classes))
    if len(settings) > 1:
        scored = prefix_predictions(model, check_rows, [s["numTrees"] for s in settings], [label])
        found = [F.get("predictions", i) for i in range(len(settings))]
    else:
        scored, found = model.transform(check_rows), [F.col("prediction")]
    row = scored.where(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(p == F.col(label)).alias(f"h{i}") for i, p in enumerate(found)]
    ).first()
    return [(row[f"h{i}"], row["n"]) for i in range(len(settings))]


def _trial_table(spark, space: dict[str, Any], used: list[dict[str, Any]], figures: dict[str, list]) -> DataFrame:
    names = list(space)
    rows = [
        (i, *[str(s[k]) if isinstance(space[k], list) else s[k] for k in names], *[v[i] for v in figures.values()])
        for i, s in enumerate(used)
    ]
    kinds = {list: "string", int: "int", float: "double"}
    types = [kinds[list if isinstance(space[k], list) else type(space[k][0])] for k in names]
    shape = ["trial int", *[f"{k} {t}" for k, t in zip(names, types)], *[f"{name} double" for name in figures]]
    return spark.createDataFrame(rows, ", ".join(shape))


def _prepared_trials(space: dict[str, Any], n: int, seed: int, algo: str, prefixes: int, floor: int):
    settings = sample_space(space, n, seed)
    groups = shared_fits(settings, prefixes if algo == "rf" and "numTrees" in space else 1)
    return [s | {"maxBins": max(s["maxBins"], floor)} if "maxBins" in s else s for s in settings], groups


def tune_random(
    train_df: DataFrame,
    valid_df: DataFrame,
    space: dict[str, Any] = DEFAULT_SPACE,
    n: int = DEFAULT_TRIALS,
    parallelism: int = 4,
    seed: int = 42,
    algo: str = "rf",
    label: str = LABEL,
    key: str = KEY,
    feature_mode: str = "all_numeric",
    prefixes: int = DEFAULT_PREFIXES,
) -> Search:
    """Fit settings on the training part and rate ``n`` on the validation part.

    The feature vectors are built and staged once, the classes are looked up once, and every fit is a
    distributed one of its own, ``parallelism`` at a time. ``prefixes`` trials share a forest: they differ
    in ``numTrees`` alone, and its first trees are the smaller forests; 1 draws all settings anew. Ties go to the
    earlier trial. The trials show the ``maxBins`` used, which is raised to the largest number of categories.
    """
    features = feature_model(train_df, label, key, feature_mode)
    fit_rows = stage(features.transform(train_df).select("features", label))
    check_rows = stage(features.transform(valid_df).select("features", label))
    classes = class_values(fit_rows, label)
    used, groups = _prepared_trials(space, n, seed, algo, prefixes, floor := bins_needed(features))
    # Read by every trial.
    fit_cached, check_cached = fit_rows.persist(), check_rows.persist()

    def rate(group: list[int]) -> list[tuple[int, int]]:
        return _hits(fit_cached, check_cached, [used[i] for i in group], algo, seed, label, floor, classes)

    spark = train_df.sparkSession
    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(rate), groups))
    fit_cached.unpersist()
    check_cached.unpersist()

    accuracies = [hits / max(1, rows) for group in found for hits, rows in group]
    best = max(range(n), key=lambda i: (accuracies[i], -i))
    trials = _trial_table(spark, space, used, {"accuracy": accuracies})
    return Search(trials, used[best], features, fit_rows.unionByName(check_rows))


class FoldSearch(NamedTuple):
    """A search, and what each trial got right in each fold: ``trial, fold, n_rows, n_hits``."""

    search: Search
    folds: DataFrame


def tune_folds(
    df: DataFrame,
    space: dict[str, Any] = DEFAULT_SPACE,
    n: int = DEFAULT_TRIALS,
    folds: int = 5,
    parallelism: int = 4,
    seed: int = 42,
    algo: str = "rf",
    label: str = LABEL,
    key: str = KEY,
    feature_mode: str = "all_numeric",
    prefixes: int = DEFAULT_PREFIXES,
) -> FoldSearch:
    """Rate ``n`` settings on each of some folds, fitted on the others; the best has the most right predictions in all.

    Folds go by a hash of the key. The vectors of all rows are one staged table, partitioned by fold, of which a fit
    leaves a folder out. The trials show ``accuracy``, the mean over the folds, and ``spread``, their standard deviation.
    Where the scheduler is fair, every fold has a pool of its own.
    """
    spark = df.sparkSession
    features = feature_model(df, label, key, feature_mode)
    fold = split_part(key, (1.0 / folds,) * folds, seed).alias("fold")
    path = stage_path(spark)
    vectors = features.transform(df.where(F.col(label).isNotNull())).select("features", label, fold)
    vectors.repartition("fold", F.pmod(F.hash("features"), F.lit(spark.sparkContext.defaultParallelism))).write.partitionBy("fold").parquet(path)
    rows = spark.read.schema(vectors.schema).parquet(path).persist()
    classes = class_values(rows, label)
    used, groups = _prepared_trials(space, n, seed, algo, prefixes, floor := bins_needed(features))

    def rate(job: tuple[list[int], int]) -> list[tuple[int, int]]:
        group, out = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{out}")
        parts = [rows.where(F.col("fold") != out), rows.where(F.col("fold") == out)]
        return _hits(*parts, [used[i] for i in group], algo, seed, label, floor, classes)

    jobs = [(group, f) for group in groups for f in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(rate), jobs))
    rows.unpersist()
    cells = {(i, f): cell for (group, f), rated in zip(jobs, found) for i, cell in zip(group, rated)}
    by_fold = [[cells[i, f][0] / max(1, cells[i, f][1]) for f in range(folds)] for i in range(n)]
    right = [sum(cells[i, f][0] for f in range(folds)) for i in range(n)]
    best = max(range(n), key=lambda i: (right[i], -i))
    figures = {"accuracy": [statistics.fmean(x) for x in by_fold], "spread": [statistics.stdev(x) if folds > 1 else 0.0 for x in by_fold]}
    table = [(i, f, cells[i, f][1], cells[i, f][0]) for i in range(n) for f in range(folds)]
    search = Search(_trial_table(spark, space, used, figures), used[best], features, rows.drop("fold"))
    return FoldSearch(search, spark.createDataFrame(table, "trial int, fold int, n_rows long, n_hits long"))


def refit_found(search: Search, seed: int = 42, algo: str = "rf", label: str = LABEL) -> PipelineModel:
    """Train with the best settings on the vectors the search has made; ``refit`` learns the categories of all rows anew."""
    floor = bins_needed(search.features)
    classes = class_values(search.rows, label)
    fitted = fit_classifier(search.rows, algo, search.best, seed, label, floor, classes=classes)
    return PipelineModel([*search.features.stages, *fitted])


def refit(train_df: DataFrame, best: dict[str, Any], seed: int = 42, algo: str = "rf", **options) -> PipelineModel:
    """Train once more with the best settings found, all of them kept."""
    return train(train_df, algo, best, seed, **options)
