"""A corpus prepared for training: toxic documents go, repeated lines go, one document of each group of
near copies stays, personal data becomes pseudonyms, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``docs`` as they came.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm import jaccard_join, line_dedup, packing, pii, toxicity
from callgrain.llm.common import fresh_name, read, stored

THRESHOLD = 0.7
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more are rejected; null and empty texts stay."""
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored, score = toxicity.score(docs, machine)
    return scored.where(F.col(score) < THRESHOLD).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its repeated lines gone; null texts stay null."""
    cleaned, *added = line_dedup.clean_texts(docs)
    return cleaned.drop(*added)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays, linked by sets of shingles of
    NEAR_WORDS words whose similarity is NEAR_PERCENT or more; documents without words, and rows
    without an id, stay all."""
    found = jaccard_join.components(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)
    key = fresh_name(docs, "near_id")
    others = found.where("doc_id != component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(others, docs["doc_id"] == others[key], "left_anti")


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with pseudonyms in place of its personal data."""
    replaced, spans = pii.pseudonymise(docs, pii.session_key(spark))
    return replaced.drop(spans)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("PII", pseudonymise),
    ("packing", pack),
]

ORACLE_SQL = None  # scores, similarity joins and tokenizers are beyond SQL; tests hold stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
