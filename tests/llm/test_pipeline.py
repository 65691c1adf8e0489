"""The pipeline stage by stage against plain Python."""

from collections import Counter

import pytest
from conftest import SMALL, words, write
from test_jaccard import plain

import corpus_pipeline
from impactrec.llm import mixing, quality, toxicity
from impactrec.llm.queries import toxicity_model
from impactrec.llm.tables import table
from impactrec.staging import stage

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_stages(spark, odd, which):
    folder = SMALL if which == "small" else odd
    docs = table(spark, folder, "documents")

    kept = stage(STAGES["toxicity"](spark, docs, folder))
    assert kept.columns == docs.columns
    model = toxicity_model(docs, table(spark, folder, "labels"))
    scores = toxicity.score(docs, model, keep=docs.columns, names=("_score", "_verdict"))
    assert Counter(kept.collect()) == Counter(scores.where("_score < 0.3").select(*docs.columns).collect())

    good = stage(STAGES["quality"](spark, kept, folder))
    assert good.columns == docs.columns
    verdicts = quality.quality(kept, keep=("doc_id", "text"))
    assert Counter(map(tuple, good.select("doc_id", "text").collect())) == Counter(
        map(tuple, verdicts.where("kept").select("doc_id", "text").collect())
    )

    single = stage(STAGES["near duplicates"](spark, good, folder))
    assert single.columns == docs.columns
    rows = [r["text"] for r in good.collect()]
    _, groups = plain(rows, percent=80, n=5)
    by_text = {t: g for t, g in zip(rows, groups)}
    assert sorted(by_text[r["text"]] for r in single.collect()) == sorted(set(groups))

    mixed = stage(STAGES["mixing"](spark, single, folder))
    assert mixed.columns == docs.columns
    taken = mixing.mix(single, corpus_pipeline.SOURCE_WEIGHTS, keep=("doc_id",)).collect()
    times = Counter({r["doc_id"]: int((r["taken"] + r["size"] / 2) // r["size"]) for r in taken if r["size"]})
    if which == "small":
        assert Counter(r["doc_id"] for r in mixed.collect()) == +times

    tokens = STAGES["pieces"](spark, mixed, folder)
    assert tokens.count() == mixed.count() and tokens.where("not exact").isEmpty()


def test_near_duplicates_at_five_words(spark, tmp_path):
    """Copies with changes close together, which have less in common by four words than by the limits of op4."""
    base = words(75, 21)
    near = [*base[:30], *(f"new{i}" for i in range(3)), *base[33:]]
    far = [*base[:20], *(f"far{i}" for i in range(12)), *base[32:]]
    rows = [(i, " ".join(t), "en", "s1", 0, *"1", 2, *"34567") for i, t in enumerate([base, near, far])]
    texts = [r[1] for r in rows]
    assert len(set(plain(texts)[1])) == 3
    assert plain(texts, percent=80, n=5)[1] == [0, 0, 2]
    folder = write(spark, tmp_path, rows)
    left = STAGES["near duplicates"](spark, table(spark, folder, "documents"), folder).collect()
    assert len(left) == 2 and far == next(r["text"] for r in left if r["doc_id"] == 2).split()


def test_mixing_with_repeated_ids(spark, tmp_path):
    """The same documents are mixed however the rows are split, though many texts have one id and size."""
    rows = [(i % 2, f"word{i} " * 9, None, f"s{i % 3}", 0, *"1", 2, *"34567") for i in range(90)]
    folder = write(spark, tmp_path, rows)
    docs = table(spark, folder, "documents")
    mixed = [Counter(STAGES["mixing"](spark, docs.repartition(n), folder).collect()) for n in (1, 6)]
    assert mixed[0] == mixed[1] and mixed[0].total() > 0


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
