"""The reference workflows end to end: prepare, train, evaluate, recommend, tune."""

from __future__ import annotations

from functools import cached_property
from typing import Any, NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from impactrec.operators import metrics
from impactrec.operators.encode import encode_rules, use_feature_set
from impactrec.operators.models import aligned_scores, model_classes, score, train
from impactrec.operators.recommend import recommend
from impactrec.operators.split import split_by_key
from impactrec.operators.tune import DEFAULT_SPACE, DEFAULT_TRIALS, Search, refit, tune_random
from impactrec.sources.schema import KEY, LABEL
from impactrec.staging import stage


def prepare(products: DataFrame, feature_set: str = "full") -> DataFrame:
    """Encoded products, written once: training reads its input several times."""
    return stage(use_feature_set(encode_rules(products), feature_set))


class Trained(NamedTuple):
    model: PipelineModel
    products: DataFrame
    held_out: DataFrame


def train_on(
    prepared: DataFrame,
    algo: str,
    params: dict[str, Any] | None = None,
    seed: int = 42,
    feature_mode: str = "all_numeric",
) -> Trained:
    """Fit on 80 percent of the prepared products, and score the rest."""
    train_part, test_part = split_by_key(prepared, seed=seed)
    model = train(train_part, algo, params, seed, feature_mode=feature_mode)
    return Trained(model, prepared, score(model, test_part))


class Evaluation:
    """Metrics of scored rows; the areas, which take two more passes, are computed when asked for."""

    def __init__(self, scored: DataFrame, hard: bool):
        self._scored, self._hard = scored, hard
        self.summary = metrics.classification_metrics(scored)

    @cached_property
    def areas(self) -> DataFrame:
        return metrics.auc(self._scored, hard=self._hard)

    @cached_property
    def mean_area(self) -> DataFrame:
        return metrics.mean_auc(self.areas)


def evaluate(held_out: DataFrame) -> Evaluation:
    """Metrics and areas of the scored held-out part, which is scored and written once."""
    soft = "probability" in held_out.columns
    columns = [LABEL, "prediction", "probability"] if soft else [LABEL, "prediction"]
    scored = stage(held_out.select(*columns))
    return Evaluation(scored, hard=not soft)


def recommend_from(trained: Trained, **options) -> DataFrame:
    """Score every product and rank those in the best classes.

    Boosted models have no class probabilities; they rank by predicted class, or with
    ``by="class_scores"`` by their raw scores.
    """
    scored = score(trained.model, trained.products)
    if "probability" not in scored.columns:
        options.setdefault("by", "prediction")
        if options["by"] == "class_scores":
            scored = aligned_scores(scored, model_classes(trained.model))
    if options.get("n") is None:
        # A full ranking reads its rows twice, to find the ranges and to sort: scores are computed once.
        shown = options.get("by", "probability")
        scored = stage(scored.select(*dict.fromkeys([KEY, "Type", LABEL, "prediction", shown])))
    return recommend(scored, **options)


class Tuned(NamedTuple):
    search: Search
    model: PipelineModel
    held_out: DataFrame


def tune(
    prepared: DataFrame,
    space: dict[str, Any] = DEFAULT_SPACE,
    n: int = DEFAULT_TRIALS,
    parallelism: int = 4,
    seed: int = 42,
) -> Tuned:
    """Search on 60 and 20 percent, refit the best on these 80, score the last 20 percent once.

    Every trial has settings and a fit of its own. The refit learns the categories anew: the search knows those of the
    60 percent only, and would leave out rows with others.
    """
    train_part, valid_part, test_part = split_by_key(prepared, weights=(0.6, 0.2, 0.2), seed=seed)
    search = tune_random(train_part, valid_part, space, n, parallelism, seed, prefixes=1)
    model = refit(train_part.unionByName(valid_part), search.best, seed)
    return Tuned(search, model, score(model, test_part))
