"""Corpus pipeline: language, toxicity, near copies, benchmark passages, packing.

Each stage takes what the one before kept, written as Parquet and read again.
A row is judged by its own text, so ids may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, langid, ngram_join, packing, toxicity
from tessera.llm.queries import WORD_BPE, tokenizer_path
from tessera.llm.shared import materialise, table

#: A text is kept if its language is known and its posterior probability is at least this.
LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, nulls among them, and texts whose language is not clear."""
    return langid.in_known_language(docs, LANGUAGE_SCORE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts predicted to be toxic by a model of the labelled ones among ``docs``."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, and all texts without words."""
    return ngram_join.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts with a passage similar to a benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all texts; one row a piece, a null text being its end id alone."""
    return packing.pack(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("language_id", language_id),
    ("toxicity", drop_toxic),
    ("ngram_join", near_copies),
    ("decontamination", benchmark_passages),
    ("packing", pack_sequences),
]
#: Trained models and tokenizers have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; the result is the last stage's, one row per packed piece."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
