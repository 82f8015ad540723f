"""A corpus pipeline: language ID, near-dedup, secret redaction, mixing and packing of ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of documents.  Between the stages the rows are written to the shared folder.
An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.sizing import settle
from plumbline.llm import chosen_path, lang_mixture, markov_secrets, mixing, packing
from plumbline.llm.common import documents
from plumbline.llm.queries import word_tokenizer

SHINGLE_WORDS = 5

ORACLE_SQL = None  # tokenizing, likelihoods and minwise trees are beyond SQL; tests/llm compares with brute force


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text or no letter.  One in several languages stays."""
    told = lang_mixture.with_languages(docs, lang_mixture.fit(docs))
    kept = told.where(F.col("lang_pred") != lang_mixture.UNKNOWN)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every group of near copies, decided row by row."""
    return chosen_path.without_near_duplicates(docs, words=SHINGLE_WORDS, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mask; no document goes."""
    masked = markov_secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row per document and pass through its source that takes some of it."""
    mixed = mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, word_tokenizer(), capacity=2048)


STAGES = [("language_id", language_id), ("minhash_near_dedup", near_dedup), ("secret_scan", secret_scan),
          ("mix_sources", mix_sources), ("harmonic_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage reads what the one before has written."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
