"""From raw documents to packed training sequences, in stages that each write their result.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import jaccard, language, mixing, packing, quality, scratch
from strataflow.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep.

    Null and empty texts have no words and go; null languages and sources are groups like others; repeated rows are judged
    alike; columns are kept whatever their names; an empty table stays empty.
    """
    return quality.passing(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language, with the one identified in the text as their lang; the mix goes by it.

    Null texts and texts without letters go; so do no others. Where no row has a language to learn from, all stay as they are. Repeated
    rows stay as often as they come; an empty table stays empty.
    """
    return language.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the row with the least doc_id.

    Rows without words or without doc_id link with nothing and stay; of rows that repeat a doc_id and text one stays; an
    empty table stays empty.
    """
    return jaccard.deduplicate(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; languages keep their shares of each source's words.

    Documents without words are never taken; a null source is a source of its own, a null language a language of its own;
    rows that repeat doc_id, size, source and language are taken together; an empty table stays empty.
    """
    return mixing.mixed_documents(docs, within="lang")


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences.

    A null text is an empty one, which is a closing id alone; repeated rows are packed once each; a table without rows
    gives none.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("harmonic_packing", harmonic_packing),
]

#: Outlier estimates and the language model have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
