"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import importable

#: A word is a run of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, matched exactly first: other columns may clash with ours."""
    out = []
    for name in names:
        at = next((i for i, c in enumerate(df.columns) if c == name), None)
        if at is None:
            at = next((i for i, c in enumerate(df.columns) if c.lower() == name.lower()), None)
        if at is None:
            raise ValueError(f"no column {name} in {df.columns}")
        out.append(at)
    if len({c.lower() for c in df.columns}) < len(df.columns):  # clashing names: rename by position first
        df = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
        return df.select(*[F.col(f"_{at}").alias(name) for at, name in zip(out, names, strict=True)])
    return df.select(*names)


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: rows and bytes of text that a batch for Python has at most, about; one text is never cut
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 24


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of bounded rows and bytes, whatever the session's own bounds are."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(part for batch in batches for part in bounded(batch))

    return df.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes; an empty one as it is."""
    rows = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
    if batch.num_rows <= rows:
        yield batch
        return
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
