"""Lines that many texts of a host share."""

from compare import differences
from conftest import words
from test_queries import folder_views

import corpus_pipeline
from impactrec.llm import quality
from impactrec.llm.oracle import QUALITY
from impactrec.llm.queries import op2_quality

LINE = "Share this page with  your friends"


def hosts():
    """Six texts of a small host and six of a large one hold a line, five of a third host."""
    rows = [("small" if i < 10 else "large", i % 10 < 6 and i < 20, i) for i in range(110)]
    rows += [("third", i < 5, 200 + i) for i in range(10)]
    return [
        (i, host, "\n".join([" ".join(words(40, i)), LINE.upper() if i % 2 else LINE, " ".join(words(3, 1000 + i))][:: 1 if has else 2]))
        for host, has, i in rows
    ]


def test_lines_go_at_every_size_of_host(spark):
    docs = spark.createDataFrame(hosts(), "doc_id long, source string, text string")
    rows = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, host, text in hosts():
        gone = LINE.lower() in text.lower() and host != "third"
        assert (rows[i]["n_removed_lines"], rows[i]["n_left_words"]) == (int(gone), len(text.split()) - 6 * gone)


def test_texts_without_the_lines(spark):
    rows = [(i, host, f"{text}\n\n{LINE}\n" if i % 3 else text) for i, host, text in hosts()]
    rows += [(300, "small", f"{LINE}\nshort"), (301, "small", None), (302, None, rows[0][2]), (303, "small", rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(2)
    digest = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    kept = quality.cleaned(docs)
    assert kept.columns == docs.columns
    found = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(found) == {i for i, r in digest.items() if r["kept"]} and 300 not in found
    wanted = " ".join(LINE.lower().split())
    for i, host, text in rows:
        if i in found:
            lines = text.split("\n")
            if digest[i]["n_removed_lines"]:
                lines = [l for l in lines if " ".join(l.lower().split()) != wanted]
            assert found[i] == "\n".join(lines) and len(found[i].split()) == digest[i]["n_left_words"]
    assert LINE not in found[0] and LINE in found[302]


def test_pipeline_passes_on_what_remains(spark):
    docs = spark.createDataFrame(hosts(), "doc_id long, source string, text string")
    texts = [r["text"] for r in corpus_pipeline.drop_low_quality(spark, docs, "").where("source <> 'third'").collect()]
    assert len(texts) == 110 and not any(LINE.lower() in t.lower() for t in texts)


def test_a_line_goes_at_every_size_of_host(spark, tmp_path):
    """The same twelve copies of a line in hosts of 100, 130 and 1,000 texts, through the operator, the query and its SQL."""
    rows, i = [], 0
    for size in (100, 130, 1000):
        for k in range(size):
            rows.append((i, f"host{size}", "\n".join([" ".join(words(25, i)), LINE][: 1 + (k < 12)])))
            i += 1
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op2_quality(spark, str(tmp_path))
    lost = {r[0] for r in found.where("n_removed_lines = 1").select("doc_id").collect()}
    assert lost == {i for i, _, text in rows if LINE in text} and len(lost) == 36
    assert differences(found, folder_views(tmp_path), QUALITY) is None


def test_columns_with_the_names_used_inside(spark):
    rows = [(i, host, text, -i, f"k{i}", "h", True) for i, host, text in hosts()]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, gone long, kept string, host string, _text boolean")
    plain = {r["doc_id"]: r["text"] for r in quality.cleaned(docs.select("doc_id", "source", "text")).collect()}
    found = quality.cleaned(docs)
    assert found.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["gone"], r["kept"], r["host"]) for r in found.collect()} == {(i, t, -i, f"k{i}", "h") for i, t in plain.items()}
