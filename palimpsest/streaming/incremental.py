"""Incremental runs as streams; an extension, as batch runs only skip what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.scoring import item_metrics


def new_images(spark: SparkSession, base: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Images as they arrive; the checkpoint remembers which were seen."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(base)


def score_stream(spark: SparkSession, base: str, out: str, checkpoint: str) -> StreamingQuery:
    """Scores pairs ``subfolder, stem, prediction, reference`` as their files arrive and appends the items."""
    pairs = spark.readStream.schema("subfolder string, stem string, prediction string, reference string").parquet(base)
    return item_metrics(pairs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls and tokens by model and time window of a stream ``ts, model, input_tokens, output_tokens``."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "model")
    return grouped.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
