"""From raw documents to packed training sequences, in five stages.

Every stage takes null and empty texts, null ids, texts of any length, rows repeated whole, an empty table, and columns beside
those of documents, also ones with clashing names. All but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import stages
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.queries import vocabulary
from palimpsest.session import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, repeated rows stay or go together."""
    return stages.keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came earlier, equal or within an edit; documents without a word left go, so null and empty texts
    do. Of equal lines the one of the smallest id (null first) and place stays."""
    return stages.drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; null and empty texts are alike to nothing and
    stay, rows repeated whole stay once."""
    return stages.one_of_each_group(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; null and empty texts have no words to take and go. A null source
    is a source of its own."""
    return stages.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens; a null or empty text is its end id alone, repeated rows are packed
    each, an empty table gives no piece."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("packed", packed)]

#: edit distance over code points, groups by links and hash-random order have no SQL of a sane size; tests/llm/test_pipeline.py has brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
