"""Sources that are tables already."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import century, clean_census


def corpus_rows(rows: DataFrame, host: str) -> DataFrame:
    """``record_id, url, text, parish, bucket`` of rows from a host that have text."""
    kept = rows.filter(F.coalesce("url", F.lit("")).contains(host) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return kept.select("record_id", "url", "text", F.coalesce("parish", F.lit("unk")).alias("parish"), century(F.col("start_date")).alias("bucket"))


def census(rows: DataFrame) -> DataFrame:
    """Cleaned texts of more than two characters, with their length."""
    cleaned = rows.withColumn("text", clean_census(F.col("text"))).withColumn("len", F.char_length("text").cast("long"))
    return cleaned.filter("len > 2").withColumn("source_image", F.lit(""))


def load_sources(spark: SparkSession, paths: dict[str, str], splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Tables ``<path>/<split>`` of several sources in one, with ``source`` and ``split``; other splits are left."""
    every = [spark.read.parquet(f"{path}/{split}").withColumn("source", F.lit(name)).withColumn("split", F.lit(split)) for name, path in paths.items() for split in splits]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)
