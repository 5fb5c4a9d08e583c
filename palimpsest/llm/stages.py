"""What the operators decide, applied to tables of documents: each function gives a table with the same columns.

All of them take nulls in any column, empty and very long texts, rows repeated whole, empty tables (which give empty ones) and
extra columns, also with clashing names, which come along. Rows are told apart by ``doc_id`` and the hash of their text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.base import WORD, text_of
from palimpsest.session import stash

#: up to so many row keys (two longs each) are sent to every task
SENT = 200_000


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def plainly(stage: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Runs a stage with columns beyond those of documents under names that clash with nothing, also not by case."""

    @wraps(stage)
    def run(docs: DataFrame) -> DataFrame:
        names, plain = docs.columns, []
        for i, name in enumerate(names):
            plain.append(name if name in OWN and name not in plain else f"__extra_{i}")
        return stage(docs.toDF(*plain)).toDF(*names)

    return run


def with_row(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row", F.xxhash64(F.col("doc_id"), text_of()))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id, row`` are in ``gone``."""
    gone = stash(gone.select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= SENT else gone
    return with_row(docs).join(side, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left_anti").select(*docs.columns)


def once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with whole repeats left out, if ``keys(doc_id, row)`` has any."""
    repeats = keys.groupBy("doc_id", "row").agg(F.count("*").alias("n")).filter("n > 1")
    return docs if repeats.isEmpty() else with_row(docs).dropDuplicates(["doc_id", "row"]).select(*docs.columns)


@plainly
def keep_quality(docs: DataFrame) -> DataFrame:
    """Rows that the quality rules keep, repeated ones each; null and empty texts go."""
    from palimpsest.llm.quality import quality_rules

    judged = quality_rules(docs)
    return without(docs, judged.filter("not kept"))


@plainly
def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Texts without repeated lines; a document of which no word is left goes, so null and empty texts do. Of equal lines the
    one with the smallest doc_id (null first) and place stays; rows repeated whole keep the same lines."""
    from palimpsest.llm.line_dedup import line_dedup

    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = line_dedup(docs, others).filter(F.col("kept").rlike(WORD))
    held = {c: f"other_{i}" for i, c in enumerate(others)} | {"doc_id": "doc_id", "text": "kept"}
    return left.select(*[F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col(held[c]).alias(c) for c in docs.columns])


@plainly
def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of documents that are linked only the one with the smallest doc_id stays, and of several with that id, or where all have none, one. Null and empty texts are linked with nothing and stay; rows repeated whole stay once."""
    from palimpsest.llm.ngram_join import jaccard_groups

    groups = stash(jaccard_groups(docs), "groups").filter("n_shingles > 0")
    stay = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("stay"))
    gone = groups.join(stay, "component").filter(~(F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("row") == F.col("stay.row"))))
    return once(without(docs, gone), groups)


@plainly
def mixed(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix begins them: not at all, once or twice. Null and empty texts have no words to take and go;
    rows repeated whole count each. Ties of the random order go by doc_id."""
    from palimpsest.llm.mixing import mix

    taken = stash(mix(docs).select("doc_id", F.col("h").alias("row"), "copies"), "copies")
    docs = once(docs, taken)
    copies = taken.groupBy(F.col("doc_id").alias("t_id"), F.col("row").alias("t_row")).agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    keyed = docs.withColumn("mix_row", F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text")))
    joined = keyed.join(copies, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("mix_row") == F.col("t_row")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
