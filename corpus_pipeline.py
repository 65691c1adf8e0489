"""From raw documents to token ids: the operators of ``impactrec.llm`` as stages of one pipeline.

Every stage reads what the one before has written, decides on all its rows, and returns the columns
of ``documents``; the last returns token ids in place of the text. Stages that decide on the corpus
as a whole number the rows first, so that repeated or missing ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from impactrec.llm import jaccard, mixing, quality, toxicity, unigram
from impactrec.llm.queries import PIECES, SOURCE_WEIGHTS, toxicity_model
from impactrec.llm.tables import small, table
from impactrec.staging import stage, staged

_ROW = "_pipeline_row"

#: Near duplicates share 80 % of their shingles of five words; ``op4_jaccard`` has limits of its own.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with a number for each row."""
    return stage(docs.withColumn(_ROW, F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, learned from the labels, does not reject."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=docs.columns, names=("_pipeline_score", "_pipeline_toxic"))
    return scored.where("_pipeline_toxic = 0").select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules, without the lines that many texts of their source share."""
    return quality.cleaned(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Documents without words are alone in their group."""
    rows = _numbered(docs)
    texts = rows.select(F.col(_ROW).alias("doc_id"), "text")
    groups = jaccard.near_duplicates(texts, n=SHINGLE_WORDS, percent=NEAR_PERCENT)
    gone = stage(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(_ROW)))
    return rows.join(small(gone, gone.count()), _ROW, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut if half of it fits."""
    rows = _numbered(docs)
    mixed = mixing.mix(rows, SOURCE_WEIGHTS, keep=("doc_id", _ROW), ties=("text", "lang", "n_chars"))
    times = F.floor((F.col("taken") + F.col("size") / 2) / F.col("size")).cast("int")
    taken = stage(mixed.where("taken > 0").select(_ROW, times.alias("_pipeline_times")).where("_pipeline_times > 0"))
    repeated = rows.join(small(taken, taken.count()), _ROW)
    return repeated.withColumn("_pipeline_copy", F.explode(F.sequence(F.lit(1), F.col("_pipeline_times")))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return unigram.encode(docs, PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL cannot express the learned model and the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again. What a stage has staged for itself goes when it has been written."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        with staged(spark):
            docs = stage(step(spark, docs, sf_dir), result=True)
    return docs
