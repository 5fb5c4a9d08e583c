"""Work that was done several times for a result is done once."""

from palimpsest.functions.text import strip
from palimpsest.operators import scoring
from palimpsest.plans.registry import QUERIES
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_compared_once(spark):
    pairs = spark.createDataFrame([("a", "abcd", "abed"), ("a", "xy", "xy"), (None, "q", "qq")], "source string, reference string, prediction string")
    losses = spark.createDataFrame([("a", 0.5)], "source string, loss double")
    got = scoring.evaluate_sources(pairs, losses)
    assert "_distances" not in plan(got)
    rows = {r["source"]: r for r in got.collect()}
    assert [rows["a"][c] for c in ("n", "cer_micro", "wer_micro", "loss")] == [2, 1 / 6, 0.5, 0.5]
    assert [rows["ALL"][c] for c in ("n", "cer_micro", "wer_micro")] == [3, 2 / 7, 2 / 3]
    assert {r["source"]: r["cer_micro"] for r in scoring.evaluate_sources(pairs.filter("false"), losses).collect()} == {"ALL": None}


def test_words_are_split_once_for_all_buckets(spark, sf_dir):
    assert plan(QUERIES["p14_word_buckets"](spark, sf_dir)).count("split(reference") == 1


def test_strip_looks_at_ends_only_where_needed(spark):
    texts = ["", " ", "a", " a b\n", "a\x0b", "\x1ca\x85", "a b", "\n\n", "a\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t")).alias("s"))
    assert [r["s"] for r in df.collect()] == [t.strip() for t in texts]
