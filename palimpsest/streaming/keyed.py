"""State by key across runs: what one run over all rows would keep, kept by runs over what is new."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from palimpsest.session import importable


class FirstRows(StatefulProcessor):
    """Lets the first ``cap`` rows of a key through, over all runs; in a run, those with the smallest ``order``."""

    def __init__(self, cap: int, order: str, columns: list[str]) -> None:
        self.cap, self.order, self.columns = cap, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType().add("n", "long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        room, kept = self.cap - n, None
        for frame in rows:  # at most `cap` rows are held
            if room > 0:
                both = frame if kept is None else pd.concat([kept, frame])
                kept = both.sort_values(self.order, kind="stable").head(room)
        if kept is not None:
            self.seen.update((n + len(kept),))
            yield kept[self.columns]

    def close(self) -> None:
        pass


def capped_stream(rows: DataFrame, keys: list[str], order: str, cap: int = 1) -> DataFrame:
    """The rows of a stream that are among the first ``cap`` of their key: first-wins with a cap of 1.

    State is a count for each key. Rows of a run are ordered by ``order``; a later run's rows come after, so runs should get
    what comes later in ``order``. Needs the RocksDB state store (``stateful_session``).
    """
    importable(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(FirstRows(cap, order, rows.columns), rows.schema, "Append", "None")


def stateful_session(spark) -> None:
    """Settings that state by key needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def curate_new(spark, base: str, schema: str, out: str, checkpoint: str, keys: list[str], order: str, cap: int = 1, files: int = 1_000) -> StreamingQuery:
    """One run over the Parquet files below ``base`` that no run has seen: the rows that are kept are appended to ``out``."""
    stateful_session(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(base)
    kept = capped_stream(stream.filter(" and ".join(f"{k} is not null" for k in keys)), keys, order, cap)
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def text_keys(rows: DataFrame) -> DataFrame:
    """Two hashes of ``text`` to tell texts apart by: state holds no texts."""
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
