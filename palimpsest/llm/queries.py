"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.base import table
from palimpsest.llm.codebooks import codebook_sql
from palimpsest.llm.quality import QUALITY_SQL
from palimpsest.llm.snapshot import SNAPSHOT_SQL
from palimpsest.session import scratch


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.ngram_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance", "row")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.toxicity import predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.line_dedup import line_dedup

    lines = line_dedup(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_exact", "n_near", F.length("kept").cast("long").alias("kept_chars"), F.crc32(F.encode("kept", "UTF-8")).alias("kept_crc32"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.huffman import read_digests, write_ids

    path = scratch(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return read_digests(spark, path)


def op11_pack_freely(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.free_packing import pack_freely

    return pack_freely(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op12_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.codebooks import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op13_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.snapshot import later_documents, snapshot_diff

    docs = table(spark, sf_dir, "documents")
    return snapshot_diff(docs, later_documents(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_ngram_join": op2_ngram_join,
    "op3_pack": op3_pack,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_mix": op9_mix,
    "op10_token_ids": op10_token_ids,
    "op11_pack_freely": op11_pack_freely,
    "op12_codebooks": op12_codebooks,
    "op13_snapshot_diff": op13_snapshot_diff,
}

SQL: dict[str, str] = {
    "op4_quality": QUALITY_SQL,
    "op12_codebooks": codebook_sql(),
    "op13_snapshot_diff": SNAPSHOT_SQL,
    "op1_top_k": """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
