"""A corpus pipeline of five stages; run() writes each stage's result to the shared folder and reads it again.

Stages: drop documents without a recognisable language, drop exact copies, keep one document of each near-duplicate group, mix the
sources to their target weights (a document may then appear twice, or not at all), and encode what is left as SentencePiece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup, language, mixing, near_dedup, sentencepiece
from quadrille.llm.common import saved

NEAR_PERCENT = 80  # five-word shingles, similarity of 0.8 or more


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT, loose=near_dedup.LOOSE - 0.05)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.digests(docs, with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]
ORACLE_SQL = None  # trained and random stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
