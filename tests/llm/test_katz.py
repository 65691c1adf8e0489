"""Katz backoff against a plain model of dictionaries, which is also shown to add up to 1."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactrec.llm import katz

SCHEMA = "doc_id long, text string, block long, learn boolean"


class Plain:
    """All n-grams in dictionaries, one lookup per token."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        for text in texts:
            s = self.symbols(text)
            for k in range(1, order + 1):
                self.counts[k - 1].update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
        self.contexts = [{} for _ in range(order)]
        for k in range(1, order):
            for g, n in self.counts[k].items():
                self.contexts[k].setdefault(g[:-1], {})[g[-1]] = n
        self.single = {g[0]: n for g, n in self.counts[0].items() if g[0] is not None}
        self.total = sum(self.single.values())
        tables = [self.single, *self.counts[1:]]
        self.d = []
        for t in tables:
            often = np.bincount(np.minimum(list(t.values()) or [0], 7), minlength=8)
            self.d.append(katz.discounts(often[:7]))

    @staticmethod
    def symbols(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [None, *re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]

    def share(self, level, followers, word):
        """The discounted share of a follower, and what is left for all others."""
        total = sum(followers.values())
        taken = sum(n * self.discount(level, n) for n in followers.values())
        if total - taken <= 1e-12:
            total += 1
        n = followers.get(word, 0)
        return n * self.discount(level, n) / total, (total - taken) / total

    def discount(self, level, n):
        return self.d[level - 1][n] if n <= 5 else 1.0

    def prob(self, word, context):
        if not context:
            if not self.total:
                return 1.0
            own, left = self.share(1, self.single, word)
            return own if word in self.single else left
        level = len(context) + 1
        followers = self.contexts[level - 1].get(tuple(context))
        if not followers:
            return self.prob(word, context[1:])
        own, left = self.share(level, followers, word)
        if word in followers:
            return own
        return left * self.prob(word, context[1:]) / (1 - sum(self.prob(w, context[1:]) for w in followers))

    def score(self, text):
        s = self.symbols(text)
        return sum(math.log10(self.prob(s[i], s[max(0, i - self.order + 1) : i])) for i in range(1, len(s)))

    def base(self, text):
        s = self.symbols(text)[1:]
        return sum(math.log10((self.single.get(w, 0) + 1) / (self.total + len(self.single) + 1)) for w in s)


def corpus(seed, n=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    weight = [1 / (i + 1) for i in range(40)]
    rows = []
    for i in range(n):
        text = " ".join(draw.choices(vocabulary, weight, k=draw.randint(0, 40)))
        if i % 7 == 0:
            text += f" New{i} THE end\nof it"
        rows.append((i, text, 1, i % 3 != 2))
    return rows + [(None, None, 1, True), (5, "", 1, None), (5, "w1 W2 unseen \x0b w1", 1, False), *rows[:2]]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("sizes", [dict(), dict(block_tokens=150, bucket_grams=60, often=12)])
def test_matches_dictionaries(spark, order, sizes):
    """Whole, and in many blocks and buckets with salted contexts."""
    rows = corpus(order)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plain = Plain([t for _, t, _, learn in rows if learn], order)
    found = katz.score(docs, F.col("learn"), order, **sizes).collect()
    want = Counter()
    for i, text, _, learn in rows:
        s = plain.symbols(text)[1:]
        known = sum(w in plain.single for w in s)
        want[(i, not learn, len(s), known, plain.total, round(plain.base(text), 6), round(plain.score(text), 6))] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found)
    assert got == want


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_add_up_to_one(order):
    rows = corpus(9)
    plain = Plain([t for _, t, _, learn in rows if learn], order)
    contexts = [(), *[c for k in range(1, order) for c in plain.contexts[k]], ("never",) * (order - 1)]
    for context in contexts:
        total = sum(plain.prob(w, context) for w in [*plain.single, "unknown"])
        assert total == pytest.approx(1, abs=1e-9)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", 0, False), (2, None, 0, None)], SCHEMA)
    rows = {r.doc_id: r for r in katz.score(docs, F.col("learn")).collect()}
    assert [rows[1][c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")] == [3, 0, 0, 0.0, 0.0]
    assert rows[2].held_out and rows[2].n_tokens == 1


def test_discounts():
    d = katz.discounts(np.array([0, 1000, 300, 150, 90, 60, 45]))
    assert d[0] == 0 and (np.diff(d[1:]) > 0).all() and 0 < d[1] < 1
    # What is taken away in all is Good and Turing's share of the unseen.
    n, r = np.array([1000, 300, 150, 90, 60]), np.arange(1, 6)
    assert ((1 - d[1:]) * r * n).sum() == pytest.approx(1000)
    assert katz.discounts(np.array([0, 5, 0, 0, 0, 0, 0])).tolist() == [0, 0.5, 0.75, 2.5 / 3, 0.875, 0.9]


def test_packing():
    for values in (np.array([], np.int64), np.array([3, -1, 2**62, 0]), np.array([0.5, -1e300])):
        assert katz.unpack(katz.pack(values), values.dtype.type).tolist() == values.tolist()


def test_a_language_is_more_likely_than_noise(spark):
    """Held-out texts score better under two words than under one, in order more than shuffled."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200").limit(300)
    learn = F.col("doc_id") % 5 != 0
    one, two = (katz.score(docs, learn, k).where("held_out").agg(F.sum("score")).first()[0] for k in (1, 2))
    assert two > one
