import random

from impactrec.operators import DEFAULT_SPACE, propose, sample_space, tune_adaptive
from impactrec.operators import split_by_key
from impactrec.plans.workflows import prepare

SPACE = {"x": (0.0, 10.0), "y": (-5.0, 5.0), "depth": (1, 40), "kind": ["a", "b", "c"]}


def _objective(s):
    return -((s["x"] - 7) ** 2) - (s["y"] + 2) ** 2 - ((s["depth"] - 9) / 4) ** 2 - (0 if s["kind"] == "b" else 3)


def _adaptive(seed, n=60):
    source, seen = random.Random(seed), [(s, _objective(s)) for s in sample_space(SPACE, 16, seed)]
    while len(seen) < n:
        seen += [(s, _objective(s)) for s in propose(SPACE, seen, 4, source)]
    return max(score for _, score in seen[:n])


def test_learns_more_than_random_search():
    random_best = [max(map(_objective, sample_space(SPACE, 60, seed))) for seed in range(10)]
    adaptive_best = [_adaptive(seed) for seed in range(10)]
    assert sum(adaptive_best) > sum(random_best)
    assert sum(a > r for a, r in zip(adaptive_best, random_best)) >= 8


def test_proposals_stay_in_the_space_and_repeat():
    seen = [(s, s["maxDepth"]) for s in sample_space(DEFAULT_SPACE, 20, 3)]
    first = propose(DEFAULT_SPACE, seen, 50, random.Random(1))
    assert first == propose(DEFAULT_SPACE, seen, 50, random.Random(1))
    for settings in first:
        for name, choice in DEFAULT_SPACE.items():
            if isinstance(choice, list):
                assert settings[name] in choice
            else:
                assert choice[0] <= settings[name] <= choice[1] and type(settings[name]) is type(choice[0])


def test_one_or_equal_trials_and_a_single_value():
    space = {"x": (3, 3), "y": (2.0, 2.0)}
    assert propose(space, [({"x": 3, "y": 2.0}, 0.5)], 2, random.Random(0)) == [{"x": 3, "y": 2.0}] * 2
    assert propose(space, [({"x": 3, "y": 2.0}, 0.5)] * 9, 1, random.Random(0)) == [{"x": 3, "y": 2.0}]


def test_search_on_products(noisy):
    train, valid = split_by_key(prepare(noisy))
    space = {"maxDepth": (1, 6), "maxBins": (16, 64), "minInfoGain": (0.0, 0.3)}
    found = tune_adaptive(train, valid, space, n=6, batch=2, startup=2, seed=3, algo="dt")
    trials = {r.trial: r for r in found.trials.collect()}
    assert sorted(trials) == list(range(6))
    best = max(trials.values(), key=lambda r: (r.accuracy, -r.trial))
    assert found.best["maxDepth"] == best.maxDepth and found.best["maxBins"] == best.maxBins
