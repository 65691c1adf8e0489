"""The registered queries of the operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from impactrec.llm import conversations, html, html_examples, jaccard, katz, knn, language, licenses, mixing, quality, sharding, spelling, toxicity, unigram
from impactrec.llm.tables import held_out, table

#: A public SentencePiece model; on a cluster, where the driver finds it.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

#: The weights of the sources in code-point order, repeating.
SOURCE_WEIGHTS = (3, 1, 2)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), bins=40)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages, html_examples.labelled_pages()))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model | None:
    """Learned from the labelled documents that aren't held out."""
    return toxicity.fit(toxicity.labelled(docs.where(~held_out()), labels.where(~held_out())))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), ~held_out(modulus=7))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.runs(table(spark, sf_dir, "documents"))
    return spelling.variants(spelling.vocabulary(words))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_shards, op2_quality, op3_mixing, op4_jaccard, op5_nearest, op6_pieces, op7_licenses, op8_language, op9_extract, op10_toxicity,
        op11_katz, op12_spelling, op13_prefix_trie,
    )
    return {f.__name__: f for f in operators}
