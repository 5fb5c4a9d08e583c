"""Frequency tables, counts by split, collected records and the learning-curve grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(df: DataFrame, key: Column | str, name: str = "value") -> DataFrame:
    """``value, n, share``."""
    counted = df.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def annotated_counts(df: DataFrame) -> DataFrame:
    """``split, images, annotated``."""
    return df.groupBy("split").agg(F.count("*").alias("images"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("annotated"))


def collected(df: DataFrame, key: str, order: str, *fields: str, name: str = "records") -> DataFrame:
    """One array of records for each key, in order."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias(name))


def curve(grid: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row for each key and size with the dev and test means; ``-`` where a run is missing."""
    cells = grid.join(metrics, ["key", "size", "split"], "left")
    cells = cells.withColumn("cell", F.coalesce(F.format_string("%.4f", "cer_mean"), F.lit("-")).alias("cell"))
    cells = cells.withColumn("cell", F.when(F.col("cer_mean").isNull(), F.lit("-")).otherwise(F.col("cell")))
    return cells.groupBy("key", "size").pivot("split", ["dev", "test"]).agg(F.first("cell"))


def grid(keys: DataFrame, sizes: DataFrame, splits: DataFrame) -> DataFrame:
    """All cells of three short lists."""
    return keys.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(splits))


def top_frequent(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n most frequent values; ties by where they first stand."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_at")).orderBy(F.col("n").desc(), "first_at").limit(n)
