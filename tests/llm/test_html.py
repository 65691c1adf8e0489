import html as entities
import re
from itertools import product

import numpy as np
import pytest

from impactrec.llm import html
from impactrec.llm.html_examples import labelled_pages


@pytest.fixture(scope="module")
def model(spark):
    return html.fit(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), labelled_pages())


def test_marginals_match_all_states():
    rng = np.random.default_rng(4)
    forest = html.Forest()
    forest.add("<div class=ad>a<p>b, c. <a href=x>d</a></p></div><article><p>e</p></article>")
    forest.add("<p>f")
    arrays = forest.arrays()
    model = html.Model(rng.normal(size=html._SIZE), rng.normal(size=(2, 2, 2)))
    single, joint = html.messages(arrays, model)
    n = len(arrays.parent)
    weight, total, pair = np.zeros(n), 0.0, np.zeros((n, 2, 2))
    for state in product((0, 1), repeat=n):
        log = sum(model.weights[arrays.features[v]].sum() for v in range(n) if state[v])
        for v, p in enumerate(arrays.parent):
            if p >= 0:
                log += model.pairs[arrays.leaf[v], state[v], state[p]]
        p = np.exp(log)
        total += p
        weight += p * np.array(state)
        for v, above in enumerate(arrays.parent):
            if above >= 0:
                pair[v, state[v], state[above]] += p
    assert single == pytest.approx(weight / total)
    children = arrays.parent >= 0
    assert joint[children] == pytest.approx(pair[children] / total)


def test_pages_of_other_templates(model):
    forest = html.Forest()
    for page in labelled_pages(150, seed=77):
        forest.add(page)
    single, _ = html.messages(forest.arrays(), model)
    size, y = np.array([len(t or "") for t in forest.texts]), np.array(forest.labels)
    found = single >= 0.5
    hit = size[found & (y == 1)].sum()
    assert hit / size[found].sum() > 0.95 and hit / size[y == 1].sum() > 0.95


def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in html.extract(pages, model).collect()}
    for row in pages.collect():
        inside = re.search(r"<article>(.*)</article>", row["html"], re.S)[1].replace("<br>", " ")
        blocks = [entities.unescape(re.sub(r"<[^>]+>", "", b)).split() for b in re.split(r"</?(?:p|h1)>", inside)]
        assert texts[row["page_id"]] == "\n".join(" ".join(b) for b in blocks if b)


def test_odd_pages(spark, model):
    long = "<article>" + "<p>Some words of a long page, which go on.</p>" * 20_000 + "</article>"
    rows = [
        (1, None, None), (2, "u", ""), (3, "u", "   \n"), (4, "u", "no markup at all &amp; more, it seems. Two sentences."),
        (5, "u", "<p"), (6, "u", "</div></p><b>"), (7, "u", "<script>x"), (8, "u", long), (8, "u", long), (None, None, "<!-- a"),
        (9, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (10, "u", "<a href='x>broken</a><p title=\">\">y</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'x' as text", "7 as n_chars")
    out = html.extract(pages, model).collect()
    assert sorted((r["page_id"] for r in out), key=repr) == sorted((r[0] for r in rows), key=repr)
    by_id = {r["page_id"]: r for r in out}
    assert all(by_id[i]["text"] == "" and by_id[i]["n_chars"] == 0 for i in (1, 2, 3, 7, None))
    assert by_id[8]["text"].count("\n") == 19_999 and by_id[8]["n_chars"] == len(by_id[8]["text"])


def test_blocks_and_references():
    forest = html.Forest()
    forest.add("<p>a &lt;b&gt;\n\t c<br>d<p>e<i>f</i>g<ul><li>h<li>i</ul>j<style>k</style>&eacute;")
    assert [t for t in forest.texts if t] == ["a <b> c d", "efg", "h", "i", "jé"]


def test_only_scripts_styles_and_titles_are_skipped():
    def texts(page):
        forest = html.Forest()
        forest.add(page)
        return [t for t in forest.texts if t]

    assert texts('<p>one <svg class="i"/> two</p><p>three</p>') == ["one two", "three"]
    assert texts("<p>a <math/>b <math><mi>x</mi><mo>=</mo><mn>1</mn></math> c</p>d") == ["a b x=1 c", "d"]
    assert texts("<svg><title/><style/><path d=''/></svg>a<title-bar>b</title-bar>") == ["a", "b"]
    for name in ("object", "noscript", "iframe", "template", "textarea", "svg", "math"):
        assert " ".join(texts(f"<p>a <{name}>b</p><p>c</p>")).split() == ["a", "b", "c"]
    assert texts("a<script src=x/>s</script><style>t</style><title>u</title>b<script>v") == ["ab"]
