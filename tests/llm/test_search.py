"""Exact top-k search and license scans against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactrec.llm import knn, licenses


def brute(rows, wanted, k, scale=1024):
    ok = [(i, np.floor(np.array(v, float) * scale).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in dict((i, v) for i, v in ok if wanted(i)).items():
        best = sorted((-int(x @ v), i) for i, v in ok if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("blocks", [{}, {"query_block": 2, "data_block": 40, "pivots": 5, "groups": 3}])
def test_top_k(spark, blocks):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 4
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=4) * 0.3]) for i in range(200)]
    rows += [(1000 + i, rows[10][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan")] * 4), (304, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(305, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cell", "2 as id", "3 as dist")
    found = knn.top_k(df, F.col("vec_id") % 5 == 0, k=7, **blocks).collect()
    assert {tuple(r) for r in found} == brute(rows, lambda i: i % 5 == 0, 7)


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in knn.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 512 * 1024)]
    one = df.where("vec_id = 0")
    assert knn.top_k(one, F.col("vec_id") == 0).collect() == []


def test_only_cells_in_reach_are_sent(spark, monkeypatch):
    """With cells far apart, the blocks solved hold few vectors for each group of queries."""
    rng = np.random.default_rng(6)
    centres = np.eye(8) * 10
    rows = [(i, (centres[i % 8] + rng.normal(size=8) * 0.01).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent, needed = [], knn.needed_vectors
    monkeypatch.setattr(knn, "needed_vectors", lambda *args: sent.append(needed(*args)) or sent[0])
    monkeypatch.setattr(knn, "choose_pivots", lambda vectors, n: (centres * 1024).astype(np.int64))
    assert knn.top_k(df, F.col("vec_id") < 8, k=7, groups=8).count() == 56
    assert 100 <= sent[0].count() <= 1000


def test_a_key_asks_with_its_valid_vector(spark):
    """Key 0 first with a null, then with two valid vectors; the smaller asks, the other is no candidate of its own key."""
    rows = [(0, None), (0, [1.0, None]), (0, [0.5, 0.0]), (0, [0.25, 9.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    found = knn.top_k(df, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 2, 9 * 1024 * 1024), (0, 2, 1, 256 * 1024)]


def test_vectors_that_cannot_be_compared_are_named(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="1 components at key 7, 3 at key 6"):
        knn.top_k(df, F.col("vec_id") == 5)
    df = spark.createDataFrame([(5, [1.0, 2.0]), (6, [1e8, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="at key 6, do not fit"):
        knn.top_k(df, F.col("vec_id") == 5)


def _words(text):
    return [w.decode("utf-8", "replace") for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]


def test_notices_match_all_templates(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    texts = [t.text for t in licenses.TEMPLATES]
    more = ["\n".join(texts), " ".join(texts[:3]), texts[1][:200], texts[1].replace(" ", "\n"), texts[4].upper(), "mit mit license license"]
    rows = [(1000 + i, t) for i, t in enumerate([*texts, *more])]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))

    def part(block, template):
        """The best place, by looking at every word as its start."""
        need = set(_words(template.text))
        least, best = len(need) if len(need) < 12 else np.ceil(0.8 * len(need) - 1e-9), 0
        if len(need & set(block)) < least:
            return 0
        for i in range(len(block)):
            held = set(block[i : i + 2 * len(_words(template.text))])
            if block[i] in need and set(template.must) <= held and not held & set(template.without):
                best = max(best, len(need & held))
        return best / len(need) if best >= least else 0

    def wanted(text):
        lines = (text or "").split("\n")
        blocks, run = [l for l in lines if _words(l)], []
        for line in [*lines, ""]:
            if _words(line):
                run.append(line)
            else:
                blocks += ["\n".join(run)] if len(run) > 1 else []
                run = []
        return sorted((t.label, p) for b in blocks for t in licenses.TEMPLATES if (p := part(_words(b), t)))

    found = licenses.scan(both).select("doc_id", "notices").collect()
    pairs = sorted(((r["doc_id"], sorted((n["label"], n["containment"]) for n in r["notices"])) for r in found), key=repr)
    assert pairs == sorted(((r["doc_id"], wanted(r["text"])) for r in both.collect()), key=repr)


@pytest.mark.parametrize("text, labels", [
    ("Released under the BSD License", ""),
    ("Released under the Apache License", "apache"),
    ("the book was released under a new license by the council", ""),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("This work is licensed under the GNU General Public License, version 2", "gpl,gpl-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ""),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ""),
    ("Released under the MIT License.", "mit"),
    ("released " + "x " * 30 + "under the " + "y " * 30 + "mit " + "z " * 30 + "license", ""),
    ("word " * 20_000 + "Licensed under the Apache License, Version 2.0. " + "word " * 20_000, "apache,apache-2.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
     "License as published by the Free Software Foundation", "lgpl"),
])
def test_neighbouring_licenses(spark, text, labels):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.digest(licenses.scan(docs)).first()["labels"] == labels
