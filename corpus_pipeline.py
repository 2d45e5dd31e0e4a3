"""A training corpus from raw documents: quality, lines, near duplicates, mixture, tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, lines, minhash, mixing, quality
from tickloom.llm.common import durable, table
from tickloom.llm.queries import VOCABULARY


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing is left."""
    return lines.drop_repeated(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.keep_first(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, at most three times."""
    return mixing.copies(docs, weights=(1, 2, 3), most_passes=3, seed=17)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of token ids (packed little-endian unsigned 32-bit) for each row, with a digest of the bytes they decode to."""
    coded = bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", encode),
]

#: Logistic regression, sketches and tokens aren't SQL; a test holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each on all that the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
