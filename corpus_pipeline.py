"""A corpus pipeline over documents: each stage is written as Parquet and read again as the next one's input.

Every stage returns the columns of ``documents`` but the last, which returns what
the tokenizer made of each document that is left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import bpe, decontaminate, pii, quality
from cohortry.llm.jaccard import keep_one
from cohortry.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.7 stay.  Null and empty texts score 0 and go.

    The classifier is fitted on the labels of ``sf_dir`` that are not held out, over the stage's own documents.
    """
    docs = docs.select(*COLUMNS)
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard similarity of at least 0.8 over five-word shingles, the smallest ``doc_id`` stays."""
    return keep_one(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of texts and ``n_chars`` recounted; documents that hold no word afterwards go, if they did before."""
    found = decontaminate.find(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True)
    left = found.filter((F.size("word_hits") == 0) | (decontaminate.n_hit() < F.col("n_words")))
    return left.withColumn("n_chars", F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets and ``n_chars`` is recounted; every document stays."""
    docs = docs.select(*COLUMNS)
    return pii.masked(docs, pii.find(docs))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as their number and digest, and the digest of what they decode to."""
    rank_file = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(bpe.encode(docs, rank_file, public_tokenizers.PATTERN, decoded=True, kept=False))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

# A classifier, components and a tokenizer have no SQL form; the tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the last one returns, written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
