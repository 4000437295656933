"""A corpus pipeline of four stages: quality rules, near-duplicates, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import minhash, mixing, pieces, quality
from tallyframe.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and lie near a language's references."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.one_of_each(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and in the order in which the mix takes them."""
    return mixing.mixed_documents(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces in place of each text."""
    others = tuple(c for c in docs.columns if c != "text")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=others)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing_to_weights),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: SQL can't express the sampled segmentation; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = made if place == len(STAGES) - 1 else materialize(made, "pipeline")
    return docs
