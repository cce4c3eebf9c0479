"""From documents to token ids: language, exact copies, near copies, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet to the shared folder and read
again as the next stage's documents. Whole texts go to the Python workers of each stage, so batches are small.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_bpe
from tallyframe.llm.common import documents, small_batches
from tallyframe.workspace import settle

#: Near copies share this many hundredths of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; texts that are null or have no letter go."""
    small_batches(spark)
    return language_id.known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, but for the case of A-Z, the one with the largest id."""
    small_batches(spark)
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    small_batches(spark)
    return ngram_join.one_of_each_group(docs, NEAR_WORDS, NEAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, one row per document and round of its source."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids and of what they decode to."""
    small_batches(spark)
    return sentencepiece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixture),
    ("SentencePiece encoding and decoding", pieces),
]

#: No stage but the second can be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
