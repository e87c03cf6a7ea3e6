"""The queries of the training-data operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from strataflow.llm import chat, clustering, extraction, hyperminhash, jaccard, language, mixing, neighbours, packing, quality, toxicity, trie, warc
from strataflow.tables import table


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference(table(spark, sf_dir, "conversations"))


def op3_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_block_norm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefixes(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_archive": op1_warc_archive,
        "op2_preference_chat": op2_preference_chat,
        "op3_text_density": op3_text_density,
        "op4_source_mixing": op4_source_mixing,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_harmonic_packing": op6_harmonic_packing,
        "op7_hnsw_neighbours": op7_hnsw_neighbours,
        "op8_robust_quality": op8_robust_quality,
        "op9_counterfactual_toxicity": op9_counterfactual_toxicity,
        "op10_language_crf": op10_language_crf,
        "op11_block_norm_clusters": op11_block_norm_clusters,
        "op12_hyperminhash": op12_hyperminhash,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    return {
        "op1_warc_archive": warc.ORACLE,
        "op2_preference_chat": chat.ORACLE,
        "op4_source_mixing": mixing.ORACLE,
        "op5_ngram_jaccard": jaccard.ORACLE,
        "op11_block_norm_clusters": clustering.ORACLE,
        "op12_hyperminhash": hyperminhash.ORACLE,
        "op13_prefix_trie": trie.ORACLE,
    }
