from collections import defaultdict

import pytest

from impactrec.llm.mixing import cycled_weights, mix, targets


def test_targets_stop_at_the_limit():
    goal = targets({"a": 100, "b": 1000, "c": 10}, {"a": 3, "b": 1, "c": 2}, 1665.0)
    assert goal["a"] == 200 and goal["c"] == 20 and goal["b"] == pytest.approx(1445)
    assert targets({"a": 0, "b": 4}, {"a": 1, "b": 1}, 6.0) == {"a": 0.0, "b": 6.0}
    assert targets({}, {}, 0.0) == {}


def test_weights_go_by_code_point():
    assert cycled_weights(["b", None, "a", "é", "Z"], (3, 1, 2)) == {"Z": 3, "a": 1, "b": 2, "é": 3, None: 1}


def test_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = mix(docs, (3, 1, 2)).collect()
    again = mix(docs.repartition(5), (3, 1, 2)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))


def test_texts_of_one_key_and_size_come_in_one_order(spark):
    rows = [(i % 3, f"w{i} " * 5, f"w{i}", "s") for i in range(60)] + [(9, "x y z", "x", "t")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, source string")
    seen = {
        tuple(sorted(map(tuple, mix(docs.repartition(n), (3, 1, 2), share=0.4, keep=("doc_id", "word")).select("doc_id", "word", "taken").collect())))
        for n in (1, 3, 7)
    }
    assert len(seen) == 1
