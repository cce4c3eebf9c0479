"""Registered queries of the subpackage, and their SQL twins where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import (
    exact_dedup,
    fingerprints,
    importance,
    language_id,
    line_dedup,
    lm_scoring,
    mixing,
    ngram_join,
    sentencepiece_bpe,
    substring_dedup,
    token_counts,
    vector_codes,
    warc,
)
from tallyframe.llm.common import documents


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.shingle_groups(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_recurring_lines(documents(spark, sf_dir)).drop("text")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_near(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count_with_edits(
        documents(spark, sf_dir), token_counts.revision(), vocabulary, public_tokenizers.PATTERN
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_bpe.encode_documents(documents(spark, sf_dir), model)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(documents(spark, sf_dir))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_line_dedup,
        op3_lm_scoring,
        op4_fingerprints,
        op5_token_counts,
        op6_exact_dedup,
        op7_sentencepiece,
        op8_language_id,
        op9_warc,
        op10_mixing,
        op11_vector_codes,
        op12_substring_dedup,
        op13_importance,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op12_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ),
        starts AS (SELECT row, words, unnest(range(1, len(words) - 33)) AS place FROM d WHERE len(words) >= 35),
        windows AS (SELECT row, place, sha256(array_to_string(words[place:place + 34], ' ')) AS name FROM starts),
        counted AS (SELECT row, place, count(*) OVER (PARTITION BY name) AS n FROM windows),
        gone AS (SELECT DISTINCT row, unnest(range(place, place + 35)) AS place FROM counted WHERE n > 1),
        by_row AS (SELECT row, list(place) AS gone FROM gone GROUP BY row),
        kept AS (
            SELECT doc_id, words, coalesce(len(gone), 0) AS n_removed,
                   list_filter(words, lambda w, i: NOT list_contains(coalesce(gone, []), i)) AS kept
            FROM d LEFT JOIN by_row USING (row)
        )
        SELECT doc_id, len(words) AS n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
    """,
}
