"""Tables in place: partitions that change are written anew, and rows in order are written in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.curation import upsert
from palimpsest.session import stash
from palimpsest.sinks.files import delete_tree


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: str, partition: str) -> list[str]:
    """Upserts ``new`` into the Parquet table at ``path``, which is cut into folders by ``partition``, and gives the
    partitions that were written (as text, at most as many as there are folders).

    A row whose key is in ``new`` leaves the partition it was in. Only partitions that hold such a row, or get one, are read
    whole and written; files of others stay as they are. A partition that loses its last row goes. Of equal keys in ``new``
    the highest ``order`` stays, whatever the old row's order is.
    """
    old = spark.read.parquet(path)
    kind = old.schema[partition].dataType
    new = stash(new.select(*old.columns).withColumn(partition, F.col(partition).cast(kind)), "new")
    leaving = old.join(new.select(*keys).distinct(), keys, "left_semi").select(partition)
    touched = [r[0] for r in leaving.union(new.select(partition)).distinct().collect()]  # at most one row for each folder
    if not touched:
        return []
    held = old.filter(F.col(partition).isin([t for t in touched if t is not None]) | (F.col(partition).isNull() if None in touched else F.lit(False)))
    after = stash(upsert(held, new, keys, order), "upserted")
    there = {r[0] for r in after.select(partition).distinct().collect()}
    after.repartition(F.col(partition), F.pmod(F.xxhash64(*keys), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for gone in set(touched) - there:
        delete_tree(spark, f"{path}/{partition}={'__HIVE_DEFAULT_PARTITION__' if gone is None else gone}")
    return sorted(map(str, touched))


def write_ordered(df: DataFrame, path: str, *order: Column | str, fmt: str = "parquet") -> None:
    """Writes rows so that files, read by name, and their rows give ``order`` over all of them: ranges are sorted side by
    side, and the number in a file's name is its range's. No task sees more than its range."""
    df.orderBy(*order).write.mode("overwrite").format(fmt).save(path)


def read_ordered(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """What ``write_ordered`` wrote, with ``file`` and ``row`` that tell the order: by name of file, then by row in it."""
    df = spark.read.option("recursiveFileLookup", "true").format(fmt).load(path)
    return df.withColumns({"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()})
