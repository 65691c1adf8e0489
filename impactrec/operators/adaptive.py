"""Search that learns: settings are proposed where good trials are dense and others are rare."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from impactrec.operators.models import bins_needed, class_values, feature_model
from impactrec.operators.tune import DEFAULT_SPACE, DEFAULT_TRIALS, Search, _hits, _trial_table, sample_space
from impactrec.sources.schema import KEY, LABEL
from impactrec.staging import stage

#: This part of the trials, the best, counts as good; each proposal is the best of so many draws.
GOOD_SHARE = 0.15
DRAWS = 24
#: Width of a kernel on one trial, as a part of the range, and the share of a choice's other values.
WIDTH, OTHERS = 0.2, 0.4


class _Range:
    """A kernel over a range, cut at its ends; values are scaled to the range from 0 to 1."""

    def __init__(self, choice: tuple, shrink: float):
        self.whole = isinstance(choice[0], int)
        self.low, self.high = (choice[0] - 0.5, choice[1] + 0.5) if self.whole else choice
        self.length = (self.high - self.low) or 1.0
        self.width = WIDTH * shrink

    def _below(self, x: float, centre: float) -> float:
        return 0.5 * (1 + math.erf((x - centre) / (self.width * math.sqrt(2))))

    def density(self, value, centre) -> float:
        x, c = (value - self.low) / self.length, (centre - self.low) / self.length
        inside = self._below(1.0, c) - self._below(0.0, c)
        return math.exp(-0.5 * ((x - c) / self.width) ** 2) / (self.width * math.sqrt(2 * math.pi) * inside)

    def draw(self, centre, source: random.Random):
        x = source.random() if centre is None else -1.0
        while not 0 <= x <= 1:
            x = source.gauss((centre - self.low) / self.length, self.width)
        value = min(self.low + x * self.length, self.high)
        return min(max(round(value), math.ceil(self.low)), math.floor(self.high)) if self.whole else value


class _Choice:
    """A kernel over a choice: mostly the value seen, sometimes any; densities are relative to an even choice."""

    def __init__(self, choice: list, shrink: float):
        self.choice, self.others = choice, OTHERS * shrink

    def density(self, value, centre) -> float:
        return self.others + (len(self.choice) * (1 - self.others) if value == centre else 0.0)

    def draw(self, centre, source: random.Random):
        return source.choice(self.choice) if centre is None or source.random() < self.others else centre


class _Density:
    """Parzen density of settings: an even part and a product of kernels on every trial, all of one weight."""

    def __init__(self, space: dict[str, Any], trials: list[dict[str, Any]]):
        shrink = max(1, len(trials)) ** (-1 / (len(space) + 4))
        self.trials = trials
        self.kernels = {c: (_Choice if isinstance(x, list) else _Range)(x, shrink) for c, x in space.items()}

    def log(self, settings: dict[str, Any]) -> float:
        near = (math.prod(k.density(settings[c], t[c]) for c, k in self.kernels.items()) for t in self.trials)
        return math.log((1.0 + sum(near)) / (len(self.trials) + 1))

    def draw(self, source: random.Random) -> dict[str, Any]:
        at = source.randrange(len(self.trials) + 1)
        centre = self.trials[at] if at < len(self.trials) else dict.fromkeys(self.kernels)
        return {c: k.draw(centre[c], source) for c, k in self.kernels.items()}


def propose(space: dict[str, Any], seen: list[tuple[dict[str, Any], float]], n: int, source: random.Random) -> list[dict[str, Any]]:
    """``n`` settings to try next, given settings and what they scored, higher being better.

    Each is the one, among some drawn from the density of the good trials, where that exceeds the density of the
    other trials most. A batch needs no result of its own members, so its trials can run together.
    """
    ranked = [s for s, _ in sorted(seen, key=lambda pair: -pair[1])]
    cut = max(2, math.ceil(GOOD_SHARE * len(ranked)))
    good, rest = _Density(space, ranked[:cut]), _Density(space, ranked[cut:])
    draws = [[good.draw(source) for _ in range(DRAWS)] for _ in range(n)]
    return [max(drawn, key=lambda s: good.log(s) - rest.log(s)) for drawn in draws]


def tune_adaptive(
    train_df: DataFrame,
    valid_df: DataFrame,
    space: dict[str, Any] = DEFAULT_SPACE,
    n: int = DEFAULT_TRIALS,
    batch: int = 8,
    startup: int = 16,
    parallelism: int = 4,
    seed: int = 42,
    algo: str = "rf",
    label: str = LABEL,
    key: str = KEY,
    feature_mode: str = "all_numeric",
) -> Search:
    """Like ``tune_random``, but after ``startup`` random trials each batch is proposed from what the earlier ones found.

    The trials of a batch run together. Every trial is a forest of its own. Ties go to the earlier trial, and the same
    seed and rows give the same trials. The trials show the ``maxBins`` used.
    """
    spark = train_df.sparkSession
    features = feature_model(train_df, label, key, feature_mode)
    fit_rows = stage(features.transform(train_df).select("features", label))
    check_rows = stage(features.transform(valid_df).select("features", label))
    classes, floor = class_values(fit_rows, label), bins_needed(features)
    fit_cached, check_cached = fit_rows.persist(), check_rows.persist()

    def rate(settings: dict[str, Any]) -> float:
        (hits, rows), = _hits(fit_cached, check_cached, [settings], algo, seed, label, floor, classes)
        return hits / max(1, rows)

    source = random.Random(seed)
    waiting = sample_space(space, min(startup, n), seed)
    drawn: list[dict[str, Any]] = []
    used: list[dict[str, Any]] = []
    accuracies: list[float] = []
    with ThreadPoolExecutor(parallelism) as pool:
        while waiting:
            raised = [s | {"maxBins": max(s["maxBins"], floor)} if "maxBins" in s else s for s in waiting]
            accuracies += pool.map(inheritable_thread_target(spark)(rate), raised)
            drawn, used = drawn + waiting, used + raised
            waiting = propose(space, list(zip(drawn, accuracies)), min(batch, n - len(used)), source)
    fit_cached.unpersist()
    check_cached.unpersist()
    best = max(range(n), key=lambda i: (accuracies[i], -i))
    trials = _trial_table(spark, space, used, {"accuracy": accuracies})
    return Search(trials, used[best], features, fit_rows.unionByName(check_rows))
