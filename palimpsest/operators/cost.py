"""Model usage, prices and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.constants import EUR_TO_USD, FALLBACK, HOURLY_EUR, PRICING, SELF_HOSTED


def pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in PRICING.items()], "model string, input_price double, output_price double")


def fallback(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FALLBACK.items()), "model string, next string")


def usage_cost(usage: DataFrame, prices: DataFrame, self_hosted: tuple[str, ...] = tuple(SELF_HOSTED)) -> DataFrame:
    """Totals and USD by model of ``usage(model, input_tokens, output_tokens, thinking_tokens, seconds)``.

    Thinking is billed as output, unknown models at nothing, self-hosted ones by the hour.
    """
    token = ["input_tokens", "output_tokens", "thinking_tokens"]
    sums = usage.groupBy("model").agg(F.count("*").alias("total_calls"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in token], F.sum("seconds").alias("seconds"))
    both = sums.join(F.broadcast(prices), "model", "left")  # a small fixed table
    price = lambda c: F.coalesce(c, F.lit(0.0))
    api = F.col("input_tokens") / 1e6 * price("input_price") + (F.col("output_tokens") + F.col("thinking_tokens")) / 1e6 * price("output_price")
    hours = F.col("seconds") / 3600.0 * HOURLY_EUR * EUR_TO_USD
    return both.select("model", "total_calls", *token, F.when(F.col("model").isin(*self_hosted), hours).otherwise(api).alias("cost"))


def fallback_chains(edges: DataFrame) -> DataFrame:
    """``model, step, candidate`` of every model's chain; a model that was tried ends it."""
    edges.createOrReplaceTempView("palimpsest_fallback")
    return edges.sparkSession.sql(
        """
        WITH RECURSIVE chain(model, step, candidate, tried) AS (
          SELECT DISTINCT model, 0, model, array(model) FROM palimpsest_fallback
          UNION ALL
          SELECT c.model, c.step + 1, e.next, concat(c.tried, array(e.next))
          FROM chain c JOIN palimpsest_fallback e ON c.candidate = e.model
          WHERE NOT array_contains(c.tried, e.next)
        )
        SELECT model, step, candidate FROM chain
        """
    )
