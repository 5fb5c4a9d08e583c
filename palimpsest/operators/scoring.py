"""Pairing predictions with references, and error rates by item, group and corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.constants import OUTLIER_RATIO
from palimpsest.functions.edit import char_distance, char_rate, word_distance, word_levenshtein
from palimpsest.functions.text import normalize, words
from palimpsest.session import stash


def too_long(pair: Column, ratio: float) -> Column:
    return F.char_length(pair["prediction"]) / F.greatest(F.char_length(pair["reference"]), F.lit(1)) > ratio


def normalized(both: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs of normalised texts, neither empty, of which ``keep`` holds.

    The condition filters an array of the one pair: a plain filter would be pushed below the projection, and each text
    normalised again for every comparison.
    """
    pair = F.array(F.struct(normalize(F.col("prediction")).alias("prediction"), normalize(F.col("reference")).alias("reference")))
    fine = lambda p: (p["prediction"] != "") & (p["reference"] != "") & (keep(p) if keep else F.lit(True))
    return both.select("subfolder", "stem", F.inline(F.filter(pair, fine)))


def pair_up(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """``subfolder, stem, prediction, reference`` of normalised texts that both sides have; empty ones go."""
    return normalized(predictions.join(labels, ["subfolder", "stem"]))


def collect_pairs(predictions: DataFrame, labels: DataFrame, ratio: float = OUTLIER_RATIO) -> tuple[DataFrame, DataFrame]:
    """Pairs that count, and those whose prediction is far too long."""
    both = predictions.join(labels, ["subfolder", "stem"])
    return normalized(both, lambda p: ~too_long(p, ratio)), normalized(both, lambda p: too_long(p, ratio))


def split_words(text: Column, separator: str | None = " ") -> Column:
    return words(text) if separator is None else F.filter(F.split(text, separator), lambda w: w != "")


def word_edits(separator: str | None) -> tuple[Column, Column]:
    """The edit distance of the words of a pair's texts, and how many words the reference has."""
    r, h = (split_words(F.col(c), separator) for c in ("reference", "prediction"))
    return word_distance(F.col("reference"), F.col("prediction")) if separator == " " else word_levenshtein(r, h), F.size(r)


def item_metrics(pairs: DataFrame, clip: bool = True, separator: str | None = " ") -> DataFrame:
    """``subfolder, filename, cer, wer, levenshtein, exact_match`` for each pair, over whole texts. What isn't selected of
    them isn't worked out."""
    edits, size = word_edits(separator)
    df = pairs.withColumn("levenshtein", char_distance(F.col("reference"), F.col("prediction"))).withColumn("word_edits", edits)
    cer = F.try_divide(F.col("levenshtein").cast("double"), F.char_length("reference").cast("double"))
    wer = F.try_divide(F.col("word_edits").cast("double"), size.cast("double"))
    cut = (lambda c: F.least(c, F.lit(1.0))) if clip else (lambda c: c)
    return df.select("subfolder", F.col("stem").alias("filename"), cut(cer).alias("cer"), cut(wer).alias("wer"), "levenshtein", (F.col("prediction") == F.col("reference")).cast("double").alias("exact_match"))


#: parts of the range from 0 to 1 in which medians are looked for; rates above share the last ones
STEPS = 4096


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, <value>_median``, exact. The middle is found in a histogram first, and only the values of its one or two steps
    are put in order, so no task holds the values of a group. Null values don't count."""
    df = rows.select(*keys, F.col(value).alias("x")).filter("x is not null").withColumn("step", F.least(F.floor(F.col("x") * STEPS), F.lit(1 << 24)))
    steps = df.groupBy(*keys, "step").agg(F.count("*").alias("n"))
    every = Window.partitionBy(*keys)
    past = lambda by: F.coalesce(F.sum("n").over(every.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("before", past("step")).withColumn("total", F.sum("n").over(every))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    steps = steps.filter((F.col("before") <= high) & (F.col("before") + F.col("n") > low)).drop("n")
    same = F.col("d.step") == F.col("s.step")
    for k in keys:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}"))
    near = df.alias("d").join(steps.alias("s"), same).groupBy(*[F.col(f"d.{k}").alias(k) for k in keys], "x", "total").agg(F.count("*").alias("n"), F.min("before").alias("first"))
    near = near.withColumn("at", F.min("first").over(every) + past("x"))
    holds = lambda rank: (F.col("at") <= rank) & (F.col("at") + F.col("n") > rank)
    middle = lambda rank: F.max(F.when(holds(rank), F.col("x")))
    return near.groupBy(*keys).agg(((middle(low) + middle(high)) / 2).alias(f"{value}_median"))


def summary_columns() -> list[Column]:
    return [
        F.count("*").alias("n"), F.avg("cer").alias("cer_mean"), F.coalesce(F.stddev_samp("cer"), F.lit(0.0)).alias("cer_std"),
        F.avg("wer").alias("wer_mean"), F.avg("levenshtein").alias("lev_mean"), (F.avg("exact_match") * 100).alias("exact_pct"),
    ]


def summarised(items: DataFrame, keys: list[str], rates: tuple[str, ...]) -> DataFrame:
    wanted = [c for c in ("cer", "wer") if c in rates]
    columns = [c for c, name in zip(summary_columns(), ("n", "cer", "cer", "wer", "", ""), strict=True) if name not in ("cer", "wer") or name in wanted]
    items = stash(items.select(*keys, *wanted, "levenshtein", "exact_match"), "items")  # read once for the sums and twice for a median
    out = items.groupBy(*keys).agg(*columns)
    for rate in wanted:
        found = medians(items, keys, rate).alias("m")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"m.{k}"))
        out = out.alias("o").join(found, same, "left").select("o.*", f"m.{rate}_median")
    return out


def by_group(items: DataFrame, rates: tuple[str, ...] = ("cer", "wer")) -> DataFrame:
    """Counts, means, medians and deviations of each subfolder, of the rates that are asked for."""
    return summarised(items, ["subfolder"], rates)


def report(items: DataFrame, rates: tuple[str, ...] = ("cer", "wer")) -> DataFrame:
    """Groups and the whole: ``is_total`` 1 marks the whole, which an empty table doesn't have."""
    once = F.struct(F.col("subfolder").alias("name"), F.lit(0).alias("is_total"))
    whole = F.struct(F.lit(None).cast("string").alias("name"), F.lit(1).alias("is_total"))
    return summarised(items.withColumn("in", F.explode(F.array(once, whole))).withColumn("subfolder", F.col("in.name")).withColumn("is_total", F.col("in.is_total")).drop("in"), ["subfolder", "is_total"], rates)


def nested_report(items: DataFrame) -> DataFrame:
    """One row with the numbers of all groups as one JSON text: by subfolder, global. It grows with the groups; the items
    stay rows (``sinks.files.write_report`` puts them beside it)."""
    groups = report(items)
    numbers = F.struct("n", "cer_mean", "cer_median", "cer_std", "wer_mean", "wer_median", "lev_mean", "exact_pct")
    named = F.array_sort(F.collect_list(F.when(F.col("is_total") == 0, F.struct("subfolder", numbers))))
    out = groups.agg(F.map_from_entries(F.filter(named, lambda x: x["subfolder"].isNotNull())).alias("by_subfolder"), F.max(F.when(F.col("is_total") == 1, numbers)).alias("global"))
    return out.select(F.to_json(F.struct("by_subfolder", "global")).alias("report"))


def corpus_rates(pairs: DataFrame, *keys: str, separator: str | None = " ") -> DataFrame:
    """Edits over reference length, summed over each group: ``cer_micro, wer_micro, n``."""
    edits, size = word_edits(separator)
    df = pairs.select(*keys, char_distance(F.col("reference"), F.col("prediction")).alias("e"), F.char_length("reference").alias("c"), edits.alias("we"), size.alias("w"))
    return micro_rates(df.withColumn("n", F.lit(1)), *keys)


def micro_rates(sums: DataFrame, *keys: str) -> DataFrame:
    """Rates of rows ``n, e, c, we, w``: pairs, edits and lengths in characters and words, which may be sums already."""
    return sums.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum("e"), F.sum("c")).alias("cer_micro"), F.try_divide(F.sum("we"), F.sum("w")).alias("wer_micro"))


def evaluate_sources(pairs: DataFrame, losses: DataFrame, rates: tuple[str, ...] = ("cer", "wer"), separator: str | None = " ") -> DataFrame:
    """Corpus rates by source and over all, with the loss weighted by size; sources without a loss still count in the size.

    The texts are compared once: sums by source are written, and the whole is their sum. A rate that isn't asked for is null.
    """
    of = {"cer": (char_distance(F.col("reference"), F.col("prediction")), F.char_length("reference")), "wer": word_edits(separator)}
    none = (F.lit(None).cast("int"),) * 2
    (e, c), (we, w) = (of[k] if k in rates else none for k in ("cer", "wer"))
    df = pairs.select("source", e.alias("e"), c.alias("c"), we.alias("we"), w.alias("w"))
    sums = stash(df.groupBy("source").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in ("e", "c", "we", "w")]), "sums")
    by_source = micro_rates(sums, "source").join(losses, "source", "left").select("source", "n", "cer_micro", "wer_micro", "loss")
    whole = micro_rates(sums).crossJoin(by_source.agg(F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")).alias("loss")))
    return by_source.unionByName(whole.select(F.lit("ALL").alias("source"), "n", "cer_micro", "wer_micro", "loss"))


__all__ = ["by_group", "char_rate", "collect_pairs", "corpus_rates", "evaluate_sources", "item_metrics", "medians", "nested_report", "normalized", "pair_up", "report", "split_words", "too_long"]
