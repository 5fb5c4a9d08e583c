"""Mixing sources to target weights: hash-random order within each source, cut at the source's exact budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.base import WORD, pick, text_of
from palimpsest.session import stash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2.0
#: rows of a bucket where the buckets are few; beyond MOST_BUCKETS they grow instead, as one task adds up a source's buckets
ROWS_A_BUCKET, MOST_BUCKETS = 250, 65_536


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``sources(source, source_size)``.

    Sources in code-point order (null last) have the weights in turn. A source is full at ``most`` times its size; what it
    can't take goes to the others by weight, until none is above. That fixed point is ``min(most * size, level * weight)``
    for one level: with the sources in order of ``most * size / weight``, a source is full as long as the level that fills
    the rest stands at or above it.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return levelled.select("source", "source_size", F.when(F.col("full") | final.isNull(), F.col("cap")).otherwise(final * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 17) -> DataFrame:
    """``doc_id, row_id, source, size, source_size, target, copies, taken`` for each row of ``docs(doc_id, text, source)``.

    A source takes itself whole as often as its target holds it, then documents in hash-random order until the rest of the
    budget is used to the word: the document at the cut gives only the words that are left, so a source's taken words are
    its target rounded down. ``copies`` counts how often the document is begun. Sources are cut into buckets of the
    random key, equal in expectation, so a source with a third of all rows is sorted by many tasks; prefix sums are within
    a bucket plus what earlier buckets of the source hold. Equal keys fall back on doc_id and the text's hash, so reruns
    agree. Null or empty texts have size 0 and are never taken; null sources are one source, last in order; an empty table gives none.
    Texts are counted whole however long; columns other than the three, also ones with clashing names, are left. Rows
    repeated whole are taken each. One task orders the sources and their totals: a row of three numbers for each source.
    """
    sized = pick(docs, "doc_id", "text", "source").select(
        "doc_id",
        "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("h"),
    )
    sized = stash(sized, "sizes")
    rows = sized.count()
    buckets = min(MOST_BUCKETS, max(1, -(-rows // ROWS_A_BUCKET)))
    keyed = sized.withColumn("bucket", F.expr(f"cast(pmod(shiftrightunsigned(h, 20), {buckets}) as int)"))
    width = ["source", "bucket"]
    in_bucket = Window.partitionBy(*width).orderBy("h", "doc_id")
    held = keyed.groupBy(*width).agg(F.sum("size").alias("bucket_size"))
    goal = targets(held.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.withColumn("earlier", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    plan = offsets.alias("o").join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select(
        F.col("o.source").alias("p_source"), F.col("bucket").alias("p_bucket"), "earlier", "source_size", "target"
    )
    placed = keyed.withColumn("within", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.floor(F.col("target")).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("earlier") - F.col("within")))
    return joined.select(
        "doc_id", "h", "source", "size", "source_size", "target", F.when(F.col("size") > 0, epochs + F.when(part > 0, 1).otherwise(0)).otherwise(F.lit(0)).cast("long").alias("copies"), (epochs * F.col("size") + part).cast("long").alias("taken")
    )
