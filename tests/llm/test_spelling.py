"""Spelling variants against all pairs of words."""

import random

import pytest

from impactrec.llm import spelling

ALPHABET = "abcdé"


def one_edit(a, b):
    """By the definition: one letter inserted, left out or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(vocab):
    rows = {}
    for w, n in vocab.items():
        near = [v for v in vocab if one_edit(w, v)]
        best = min(near, key=lambda v: (-vocab[v], v), default=None)
        form = best if best is not None and vocab[best] >= 2 * n else None
        rows[w] = [form, n, len(near), vocab.get(form)]
    out = set()
    for w, (form, n, near, form_n) in rows.items():
        root = w
        while rows[root][0] is not None:
            root = rows[root][0]
        out.add((w, form, root, n, near, form_n))
    return out


def found(spark, vocab, symbols=None):
    rows = spark.createDataFrame([(w, n, "x", 1) for w, n in vocab.items()], "word string, n long, key string, own long")
    return spelling.variants(rows, symbols).collect()


@pytest.mark.parametrize("symbols", [1, 2, 4, None])
def test_matches_all_pairs(spark, symbols):
    draw = random.Random(4)
    vocab = {}
    for _ in range(700):
        vocab["".join(draw.choices(ALPHABET, k=draw.choice([1, 2, 5, 5, 6, 7])))] = draw.choice([3, 3, 4, 6, 9, 12, 30, 100, 2**40])
    rows = found(spark, vocab, symbols)
    assert len(rows) == len(vocab)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == plain(vocab)


def test_chains_and_very_long_words(spark):
    """Forms that lead on sixteen times, and words of 20,000 letters with one edit between them."""
    vocab = {"a" * (5 + i): 3 * 2**i for i in range(17)}
    long = "".join(random.Random(1).choices("abcdefgh", k=20_000))
    vocab |= {long: 50, long[:9_000] + long[9_001:]: 4, long[:5] + "x" + long[6:]: 26, "é" * 12: 3, "ééééééééééée": 6, "日本語です": 5, "日本語でし": 10, "": 3}
    rows = {r.word: r for r in found(spark, vocab)}
    assert rows["aaaaa"].root == "a" * 21
    assert rows[long[:9_000] + long[9_001:]].form == long
    assert rows[long[:5] + "x" + long[6:]].form is None and rows[long].n_near == 2
    assert rows["é" * 12].form == "ééééééééééée"
    assert rows["日本語です"].form == "日本語でし"
    assert rows[""].root == "" and rows[""].n_near == 0


def test_runs(spark):
    docs = spark.createDataFrame([(i, "Über-LÉGER naïve x1y" + " word" * 100, "w", "n") for i in range(3)] + [(None, None, "", "")],
                                 "doc_id long, text string, word string, n string")
    words = [r[0] for r in spelling.runs(docs).collect()]
    assert len(words) == 3 * (5 + 100)
    assert {"Über".replace("Ü", "Ü"), "lÉger", "naïve", "x", "y"} <= set(words)
    assert {r.word for r in spelling.vocabulary(spelling.runs(docs)).collect()} <= {"lÉger", "naïve"}
