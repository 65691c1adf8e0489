from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"

#: The columns of documents, and others whose names the operators use inside.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
        T.StructField("host", T.LongType()), T.StructField("score", T.StringType()), T.StructField("shard", T.StringType()),
        T.StructField("n", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("row_key", T.StringType()),
    ]
)


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Null, empty, blank, very long, repeated, equal and nearly equal texts, with null ids, languages and sources."""
    base = words(120, 1)
    near = [*base[:60], "other", *base[61:]]
    line = " ".join(words(12, 2))
    texts: list[str | None] = [
        None, "", " \t\r\n\x0b\x0c ", "one", "one two", "One\nTWO three", " ".join(base), " ".join(base), " ".join(near),
        " ".join(base).upper(), " ".join(words(60_000, 3)), "x" * 100_000, "é" * 3000 + " ü\n" + "日本 " * 50, "\x00\x01 ▁ ▁",
        "Released under the MIT License.\n\nLicensed under\nthe Apache License, Version 2.0.", "a b c d " * 40, *[line] * 2,
        *[f"{line}\n{' '.join(words(40, 10 + i))}\n{line}" for i in range(8)], "1 2 3", "...", "\n\n\n", "\r\n".join(words(30, 5)),
    ]
    rows = []
    for i, text in enumerate(texts):
        rows.append((None if i == 4 else i, text, [None, "en", "de"][i % 3], [None, "s1", "s2", "é"][i % 4 if i % 5 else 1]))
    rows += [rows[6], rows[6], (6, "another text with the same id " + " ".join(words(30, 8)), "en", "s1"), (None, texts[8], None, None)]
    return [(*r, len(r[1] or ""), "7", 8, "9", "10", "11", "12", "13") for r in rows]


def write(spark, folder, documents, labels=()) -> str:
    spark.createDataFrame(documents, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder with the odd documents and a few labels, null ones among them."""
    labels = [(i, 1, [0, 1, None][i % 3]) for i in range(20)] + [(None, None, 1), (3, 0, 0)]
    return write(spark, tmp_path_factory.mktemp("odd"), odd_rows(), labels)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = write(spark, tmp_path_factory.mktemp("empty"), [])
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder
