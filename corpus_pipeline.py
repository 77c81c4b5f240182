"""Cleaning of a text corpus in stages; each stage works on all rows that the one before it kept.

``run`` writes every stage's rows below the shared checkpoint folder and reads them again, so a stage is computed once. The stages read and return the columns
of ``documents``; further ones are left out. Null, empty and blank texts, which have no language, go in the first stage; texts of any length are worked on
whole; of rows that repeat one stays; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm import language, packing, pseudonyms, setsketch, substring
from tillwatch.llm.tables import store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those the classifier rejects go."""
    return language.identify(docs, COLUMNS).where("not rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8), the document with the smallest doc_id."""
    return setsketch.without_near_duplicates(docs).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur more than once go; documents without any keep their text as it is."""
    return substring.with_repeats_removed(docs).select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms of the same format; n_chars is counted anew where a text changed."""
    out = pseudonyms.pseudonymise(docs, pseudonyms.job_key(spark))
    n_chars = F.when(F.size("pii_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]
#: No SQL: the language model, the vocabulary and the packing are not SQL's; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
