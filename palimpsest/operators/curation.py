"""Curating a corpus: joins on files, first-wins and capped dedup, splits without leakage, nested stratified samples."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.constants import SPLIT_WEIGHTS
from palimpsest.functions.text import century, page_key

EXTENSIONS = [".jpg", ".jpeg", ".png"]
SPLIT_ORDER = {"train": 0, "test": 1, "dev": 2}


def draw(*keys: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return F.conv(F.substring(shuffle_key(*keys, seed=seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def shuffle_key(*keys: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))


#: rows that one task ranks at most, about
ROWS_A_PART = 200_000


def ranked_in(df: DataFrame, groups: list[str], key: str, *ties: str) -> DataFrame:
    """Adds ``rn``, the rank in the group by a hash in hex. Each group is ranked in ranges of the hash, as many as the rows
    ask for, so that no task has to sort all rows of a group."""
    digits, held = 1, df.count() // ROWS_A_PART
    while held >= 16**digits:
        digits += 1
    df = df.withColumn("_part", F.substring(key, 1, digits))
    held = df.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = df.withColumn("_w", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(key, *ties)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*groups, "_part"]]
    joined = within.alias("a").join(held.alias("b"), on=same[0] if len(same) == 1 else same)
    return joined.select("a.*", (F.col("b._before") + F.col("a._w")).alias("rn")).drop("_part", "_w")


def with_labels(crops: DataFrame, labels: DataFrame) -> DataFrame:
    """Crops with their label text, empty where there is none."""
    return crops.join(labels.select("split", "subfolder", "stem", "text"), ["split", "subfolder", "stem"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def first_image(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Each label with text and the first of its images by extension; labels without image or text go."""
    rank = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("ext"))
    some = images.filter(F.col("ext").isin(EXTENSIONS)).groupBy("subfolder", "stem").agg(F.min_by("path", rank).alias("image"))
    return labels.filter(F.trim("text") != "").join(some, ["subfolder", "stem"])


def not_annotated(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations.filter("text <> ''"), ["filename", "subfolder"], "left_anti")


def not_done(todo: DataFrame, done: DataFrame, key: str = "path", size: str | None = None) -> DataFrame:
    """What has no output yet; with ``size`` outputs of no bytes don't count."""
    return todo.join(done if size is None else done.filter(F.col(size) > 0), key, "left_anti")


def with_source(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations with boxes whose image exists."""
    return annotations.filter(F.size("boxes") > 0).join(images, "filename", "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key the row with the highest ``order``, new rows before old ones of the same order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col(order).desc()))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_new", "_rank")


def weighted_split(page: Column, seed: int = 42) -> Column:
    """Split of a page by its hash: all crops of a page land together."""
    at, u, out = 0.0, draw(page, seed=seed), None
    for name, weight in list(SPLIT_WEIGHTS.items())[:-1]:
        at = round(at + weight, 10)
        out = F.when(u < at, F.lit(name)) if out is None else out.when(u < at, F.lit(name))
    return out.otherwise(F.lit(list(SPLIT_WEIGHTS)[-1]))


def assign_splits(crops: DataFrame, existing: DataFrame, seed: int = 42) -> DataFrame:
    """Crops with the split that a crop of their page already has (the first by filename), else one drawn for the page."""
    known = existing.withColumn("page", page_key(F.col("filename"))).groupBy("page").agg(F.min_by("split", "filename").alias("old"))
    return crops.withColumn("page", page_key(F.col("filename"))).join(known, "page", "left").withColumn("split", F.coalesce("old", weighted_split(F.col("page"), seed))).drop("old")


def first_wins(crops: DataFrame) -> DataFrame:
    """One crop for each subfolder and filename, the first in split order."""
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SPLIT_ORDER.items() for x in kv]), F.col("split")), F.lit(9))
    rank = F.row_number().over(Window.partitionBy("subfolder", "filename").orderBy(order, "path"))
    return crops.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def shares(sizes: dict[int, int], total: int) -> list[tuple[int, int, int]]:
    """``size, train, test``: how many pages of each size go to the first two splits, sizes from the largest on, each page to
    the split with the largest need left (of equal ones the first).

    Pages of one size take the largest of the numbers ``need - k * size``, so their number costs nothing.
    """
    weights = [Fraction(str(w)) for w in SPLIT_WEIGHTS.values()]
    held, out = [0] * len(weights), []
    for size in sorted(sizes, reverse=True):
        n, needs = sizes[size], [w * total - h for w, h in zip(weights, held, strict=True)]
        above = lambda x: [max(0, math.ceil((need - x) / size)) for need in needs]  # noqa: B023, E731  numbers larger than x
        low, high = min(needs) - n * size - 1, max(needs)
        while high - low > Fraction(1, 20 * len(weights)):  # needs are tenths: at most one number of a split lies between
            middle = (low + high) / 2
            low, high = (middle, high) if sum(above(middle)) > n else (low, middle)
        took, over = above(high), above(low)
        for i, (a, b) in enumerate(zip(took, over, strict=True)):
            took[i] += min(b - a, n - sum(took))
        held = [h + k * size for h, k in zip(held, took, strict=True)]
        out.append((size, *took[:2]))
    return out


def regroup(crops: DataFrame, seed: int = 42) -> DataFrame:
    """``page, n, split``: pages from the largest on, each to the split with the largest remaining need (train, test, dev);
    of pages of one size the first by hash are train's, then test's, then dev's.

    The driver sees how many pages have each size, not the pages.
    """
    pages = crops.groupBy("page").agg(F.count("*").alias("n")).withColumn("h", shuffle_key(F.col("page"), seed=seed))
    sizes = {r["n"]: r["pages"] for r in pages.groupBy("n").agg(F.count("*").alias("pages")).collect()}  # one row for each size
    cuts = crops.sparkSession.createDataFrame(shares(sizes, sum(n * k for n, k in sizes.items())), "n long, train long, test long")
    ranked = ranked_in(pages, ["n"], "h", "page").join(F.broadcast(cuts), "n")
    names = list(SPLIT_WEIGHTS)
    split = F.when(F.col("rn") <= F.col("train"), names[0]).when(F.col("rn") <= F.col("train") + F.col("test"), names[1]).otherwise(names[2])
    return ranked.select("page", "n", split.alias("split"))


def moved(crops: DataFrame, assigned: DataFrame) -> DataFrame:
    """Crops with their new split and whether it differs."""
    new = assigned.select("page", F.col("split").alias("new_split"))
    return crops.join(new, "page").withColumn("moved", F.col("split") != F.col("new_split"))


def split_counts(crops: DataFrame, split: str = "new_split") -> DataFrame:
    """``split, n, pct``."""
    return crops.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n")).withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def capped(rows: DataFrame, order: str, least: int = 3, share: float = 0.0005, parts: int = 256) -> DataFrame:
    """Of equal texts only the first ones by ``order`` (a number), as many as ``share`` of all rows that are long enough (one at least).

    Texts that occur more often than that are few, ``1 / share`` at most. Their rows are cut into ranges of ``order``; what
    lies below the cap stays, and only the range in which it falls is ranked. Texts are told apart by two hashes.
    """
    keys = ["_h1", "_h2"]
    long = rows.filter(F.char_length("text") >= least).withColumn("_h1", F.xxhash64("text")).withColumn("_h2", F.xxhash64(F.lit(1), "text"))
    cap = max(1, int(long.count() * share))
    often = long.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > cap).select(*keys)
    seldom, hot = long.join(often, keys, "left_anti"), long.join(often, keys, "left_semi")
    bounds = hot.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"] or []
    bounds = sorted(set(bounds))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    hot = hot.withColumn("_part", at)
    held = hot.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < cap)
    hot = hot.join(held, [*keys, "_part"])
    whole = hot.filter(F.col("_before") + F.col("_n") <= cap)
    rank = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order))
    cut = hot.filter(F.col("_before") + F.col("_n") > cap).withColumn("_rank", rank).filter(F.col("_before") + F.col("_rank") <= cap)
    return seldom.select(*rows.columns).unionByName(whole.select(*rows.columns)).unionByName(cut.select(*rows.columns))


def quotas(strata: DataFrame, sizes: DataFrame, order: str = "stratum") -> DataFrame:
    """``size, stratum, take``: how many leading rows each stratum of ``n`` rows gives for each size.

    Shares round half to even; what is missing comes from the strata in order, what is too much is cut from the last.
    """
    every = Window.partitionBy("size")
    before = every.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = strata.crossJoin(F.broadcast(sizes)).withColumn("total", F.sum("n").over(every)).withColumn("want", F.least("size", "total"))
    df = df.withColumn("k", F.least(F.bround(F.col("want") * F.col("n") / F.col("total")).cast("long"), F.col("n")))
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    df = df.withColumn("all_k", F.sum("k").over(every)).withColumn("before_k", past("k")).withColumn("rest", F.col("n") - F.col("k")).withColumn("before_rest", past("rest"))
    first = F.greatest(F.lit(0), F.least(F.col("k"), F.col("want") - F.col("before_k")))
    more = F.greatest(F.lit(0), F.least(F.col("rest"), F.col("want") - F.col("all_k") - F.col("before_rest")))
    return df.select("size", "stratum", (first + more).cast("long").alias("take"))


def stratified(rows: DataFrame, stratum: Column, key: Column, sizes: list[int], tie: str) -> DataFrame:
    """Rows of each size's sample, with ``size``; larger samples hold the smaller ones but for rounding."""
    spark = rows.sparkSession
    df = rows.withColumn("stratum", stratum).withColumn("_key", key)
    ranked = ranked_in(df, ["stratum"], "_key", tie)
    take = quotas(df.groupBy("stratum").agg(F.count("*").alias("n")), spark.createDataFrame([(s,) for s in sizes], "size long"))
    return ranked.join(take, "stratum").filter(F.col("rn") <= F.col("take")).drop("_key", "take")


def parish_century(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    key = shuffle_key(F.col("record_id"), seed=seed)
    return stratified(rows, F.concat_ws("|", F.coalesce("parish", F.lit("unk")), century(F.col("start_date"))), key, [size], "record_id")


def exact_split(rows: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` for exactly ``int(share * n)`` rows, by shuffled order."""
    df = rows.withColumn("_one", F.lit(1)).withColumn("_key", shuffle_key(F.col(key), seed=seed))
    ranked = ranked_in(df, ["_one"], "_key", key)
    n = rows.agg(F.floor(F.count("*") * share).alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).withColumn("is_test", F.col("rn") <= F.col("_n")).drop("_one", "_key", "rn", "_n")  # the count is one row


def has_splits(rows: DataFrame, names: tuple[str, ...] | list[str]) -> set[str]:
    """Which of the named splits have rows, however many others there are."""
    found = rows.agg(*[F.max(F.col("split") == n).alias(n) for n in names]).first()
    return {n for n in names if found[n]}


def complete_splits(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows of one source with train, validation and test; missing ones are cut from train (a tenth each)."""
    wanted = ("train", "validation", "test")
    there = has_splits(rows, wanted)
    missing = [s for s in wanted if s not in there]
    if not missing:
        return rows
    if "train" in missing:
        raise ValueError("a train split is needed to cut others from")
    train, rest = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    name = lambda df, s: df.withColumn("split", F.lit(s))
    if len(missing) == 2:
        first = exact_split(train, 0.2, key, seed)
        second = exact_split(first.filter("is_test").drop("is_test"), 0.5, key, seed + 1)
        parts = [name(first.filter("not is_test"), "train"), name(second.filter("not is_test"), "validation"), name(second.filter("is_test"), "test")]
    else:
        first = exact_split(train, 0.1, key, seed)
        parts = [name(first.filter("not is_test"), "train"), name(first.filter("is_test"), missing[0])]
    for part in parts:
        rest = rest.unionByName(part.select(*rows.columns))
    return rest


def missing_splits(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """``source, split`` of ``needed(split)`` that a source lacks."""
    return rows.select("source").distinct().crossJoin(F.broadcast(needed)).join(rows.select("source", "split").distinct(), ["source", "split"], "left_anti")


def combine(*sources: tuple[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sources:
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def is_subset(smaller: DataFrame, larger: DataFrame, key: str) -> DataFrame:
    return smaller.select(key).join(larger.select(key), key, "left_anti").agg((F.count("*") == 0).alias("is_subset"))


def augmented(rows: DataFrame, prefix: str = "lower_contrast_") -> DataFrame:
    """The rows and once more with a prefix on the file's name."""
    return rows.unionByName(rows.withColumn("path", F.regexp_replace("path", r"([^/]+)$", f"{prefix}$1")))


def random_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(shuffle_key(F.col(key), seed=seed), key).limit(n)
