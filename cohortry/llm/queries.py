"""The operators of this subpackage as queries over the given tables, with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import bpe, dac, decontaminate, fingerprints, jaccard, language, lexical, licences, merkle, pages, pii, quality, token_counts
from cohortry.session import staging_path


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_consistent_parsing(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_neighbours(_documents(spark, sf))


def op2_bootstrapped_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.report(pii.find(_documents(spark, sf)))


def op3_line_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return quality.score(docs, model).select(
        "doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted")
    )


def op4_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf))


def op5_licence_digests(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan(_documents(spark, sf), licences.known(spark))


def op6_token_codes(spark: SparkSession, sf: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    path = staging_path(spark, "token-codes")
    dac.write(_documents(spark, sf), tokenizer, 1, path)
    return dac.checksums(dac.read(dac.segments(spark, path)))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    return decontaminate.report(decontaminate.find(_documents(spark, sf).select("doc_id", "text"), benchmark))


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    rank_file = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(bpe.encode(_documents(spark, sf), rank_file, public_tokenizers.PATTERN, decoded=True))


def op9_trie_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf), token_counts.zipf_scores(public_tokenizers.path("piece_bpe_32k.model")))


def op10_rank_order_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    known = language.profiles(docs.filter(~language.is_held_out(F.col("doc_id"))))
    found = language.predict(docs, known)
    return found.select("doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_template_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf}/pages.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.report(merkle.proofs(merkle.build(_documents(spark, sf), merkle.tampered_leaf())))


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(_documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_consistent_parsing": op1_consistent_parsing,
    "op2_bootstrapped_pii": op2_bootstrapped_pii,
    "op3_line_crf": op3_line_crf,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_licence_digests": op5_licence_digests,
    "op6_token_codes": op6_token_codes,
    "op7_decontamination": op7_decontamination,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_trie_token_counts": op9_trie_token_counts,
    "op10_rank_order_language": op10_rank_order_language,
    "op11_template_extraction": op11_template_extraction,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op4_ngram_jaccard": jaccard.CHECKING_SQL,
    "op7_decontamination": decontaminate.CHECKING_SQL,
    "op5_licence_digests": licences.checking_sql(),
    "op12_merkle_manifest": merkle.CHECKING_SQL,
    "op13_ranked_search": lexical.CHECKING_SQL,
}
