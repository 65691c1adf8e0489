"""Language identification and toxicity: accuracy on held-out rows, and the parts against brute force."""

import numpy as np
import pytest

from impactrec.llm import language, toxicity
from impactrec.llm.queries import op8_language, op10_toxicity
from impactrec.llm.tables import held_out, table

LARGER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("classes", [1, 2, 3, 4, 5, 6, 30])
def test_codewords_differ(classes):
    code = language.codewords(classes)
    assert set(np.unique(code)) <= {-1, 1}
    assert len({tuple(c) for c in code.tolist()}) == classes
    if classes > 5:
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(apart) >= 5


def test_decoding_corrects_a_wrong_bit():
    code = language.codewords(4)
    model = language.Model(list("abcd"), code, np.eye(code.shape[1], dtype=np.float32), np.zeros(code.shape[1]))
    for c in range(4):
        seen = 3 * code[c].copy()
        seen[2] *= -0.5
        best, share, _ = language.decode(model, seen[None])
        assert best[0] == c and 0.5 < share[0] <= 1


def test_language_of_held_out_rows(spark):
    rows = op8_language(spark, LARGER).join(table(spark, LARGER, "documents").select("doc_id", "lang"), "doc_id")
    found = rows.where("held_out and lang is not null").selectExpr("avg(int(lang = lang_pred)) as a", "count(*) as n").first()
    assert found["n"] > 1000 and found["a"] > 0.97


def test_texts_without_letters_are_undetermined(spark, odd):
    rows = {r["doc_id"]: r for r in op8_language(spark, odd).where("doc_id is not null").collect()}
    docs = table(spark, odd, "documents").where("doc_id is not null").collect()
    for d in docs:
        letters = any(c.isalpha() for c in d["text"] or "")
        if d["doc_id"] != 6:
            assert (rows[d["doc_id"]]["lang_pred"] != "und") == letters


def test_nothing_to_learn_from(spark, odd):
    docs = table(spark, odd, "documents")
    assert language.fit(docs.where("false")) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert toxicity.fit(docs.selectExpr("doc_id", "text", "1 as toxic")) is None
    assert {(r["score"], r["predicted"]) for r in toxicity.score(docs, None).collect()} == {(0.0, 0)}


def test_toxicity_of_held_out_rows(spark):
    rows = op10_toxicity(spark, LARGER).join(table(spark, LARGER, "labels").select("doc_id", "toxic"), "doc_id")
    found = {(r["toxic"], r["predicted"]): r["count"] for r in rows.where("held_out").groupBy("toxic", "predicted").count().collect()}
    assert found.get((1, 1), 0) > 0.8 * (found.get((1, 1), 0) + found.get((1, 0), 0))
    assert found.get((0, 1), 0) < 0.01 * found[0, 0]
    assert rows.where(held_out() != rows["held_out"]).isEmpty()


def test_margins_are_all_pairs():
    rng = np.random.default_rng(0)
    weights, factors = rng.normal(size=9), rng.normal(size=(9, 3))
    texts = [[0, 3, 5], [2], [], [1, 2, 7, 8]]
    owner = np.array([i for i, t in enumerate(texts) for _ in t])
    out, _ = toxicity.margins(owner, np.array([x for t in texts for x in t]), 4, 0.5, weights, factors)
    for value, t in zip(out, texts):
        pairs = sum(factors[a] @ factors[b] for i, a in enumerate(t) for b in t[:i])
        assert value == pytest.approx(0.5 + sum(weights[a] for a in t) + pairs)


def test_machine_learns_a_pair():
    """Two terms that are harmless alone and toxic together, which weights alone cannot tell."""
    rng = np.random.default_rng(1)
    texts = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(1500)]
    label = np.array([float((0 in t) == (1 in t)) for t in texts])
    owner, term = np.repeat(np.arange(1500), [len(t) for t in texts]), np.concatenate(texts)
    model = toxicity.fit_machine(owner, term, label, np.ones(1500), 6, epochs=60)
    out, _ = toxicity.margins(owner, term, 1500, *model)
    assert ((out > 0) == (label == 1)).mean() > 0.97


def _insults(groups, n=4000, seed=3):
    """Texts that are toxic exactly where an insult and a mention of a group meet; each is also in 40 % of the clean texts."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        toxic = i % 2
        group = groups[rng.integers(len(groups))]
        kind = rng.random()
        said = ["insultword", group] if toxic else ["insultword"] if kind < 0.4 else [group] if kind < 0.8 else []
        filler = [f"filler{k}" for k in rng.integers(0, 300, 30)]
        text = " ".join(rng.permutation(filler + said))
        rows.append((i, text, toxic))
    return rows


@pytest.mark.parametrize("groups", [["grouponly"], ["groupone", "grouptwo", "groupthree"]])
def test_an_insult_and_a_group_are_toxic_together(spark, groups):
    rows = spark.createDataFrame(_insults(groups), "doc_id long, text string, toxic int")
    model = toxicity.fit(rows.where("doc_id % 4 <> 3"))
    scored = toxicity.score(rows, model, keep=("doc_id", "toxic")).where("doc_id % 4 in (2, 3)")
    found = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    for label in (0, 1):
        assert found.get((label, label), 0) > 0.95 * (found.get((label, 0), 0) + found.get((label, 1), 0))


def test_pairs_of_terms_that_are_neutral_alone():
    """Two of twenty terms decide, each as frequent under either label: only the pair tells."""
    rng = np.random.default_rng(2)
    texts = [np.flatnonzero(rng.random(20) < 0.5) for _ in range(5000)]
    label = np.array([float((3 in t) == (11 in t)) for t in texts])
    owner, term = np.repeat(np.arange(5000), [len(t) for t in texts]), np.concatenate(texts)
    assert toxicity.paired_terms(owner, term, label, 20).tolist() == [3, 11]
    assert toxicity.paired_terms(owner, term, rng.permutation(label), 20).tolist() == []


def test_samples_are_bounded_by_rows(spark):
    """One id and one text in many rows: no more of them reach the driver than a sample holds."""
    rows = spark.createDataFrame([(1, f"some text {i % 3}", "en", i % 2) for i in range(5000)], "doc_id long, text string, lang string, toxic int")
    drawn = []
    arrow = type(rows).toArrow
    type(rows).toArrow = lambda self: drawn.append(arrow(self)) or drawn[-1]
    try:
        language.fit(rows, per_language=10)
        toxicity.fit(rows, per_label=10)
    finally:
        type(rows).toArrow = arrow
    assert drawn[0].num_rows == 10 and drawn[1].num_rows < 60


def test_a_rare_label_stays_whole(spark):
    labels = spark.range(20_000).selectExpr("id as doc_id", "int(id % 1000 = 0) as toxic").unionByName(
        spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int"))
    docs = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    found = {r["toxic"]: r["count"] for r in toxicity.labelled(docs, labels, most=2000).groupBy("toxic").count().collect()}
    assert found[1] == 21 and 800 < found[0] < 1200


def test_other_columns_of_the_names_used_inside(spark):
    docs = spark.createDataFrame([(1, "a b", "t")], "doc_id long, text string, _text string")
    assert [tuple(r) for r in toxicity.score(docs, None, keep=docs.columns).collect()] == [(1, "a b", "t", 0.0, 0)]


def test_decoding_is_the_nearest_codeword_of_all():
    """Against a loop over all codewords and bits."""
    rng = np.random.default_rng(4)
    code = language.codewords(7)
    model = language.Model(list("abcdefg"), code, rng.normal(size=(30, code.shape[1])).astype(np.float32), rng.normal(size=code.shape[1]))
    x = rng.normal(size=(50, 30)).astype(np.float32)
    best, share, margin = language.decode(model, x)
    for i, row in enumerate(x):
        bits = [float(row @ model.weights[:, b] + model.bias[b]) for b in range(code.shape[1])]
        loss = [sum(np.log1p(np.exp(-c * z)) for c, z in zip(word, bits)) for word in code]
        ahead = sorted(loss)
        assert best[i] == loss.index(ahead[0])
        assert margin[i] == pytest.approx(ahead[1] - ahead[0], rel=1e-3)
        assert share[i] == pytest.approx(np.exp(-ahead[0]) / sum(np.exp(-z) for z in loss), rel=1e-3)
