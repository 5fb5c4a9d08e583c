"""Line dedup: of lines that are equal or within a few edits, only the first of the corpus stays.

A segment-partition edit join in DataFrame functions. For a threshold of t edits a line has t + 1 segments; two lines within
the threshold share one of them whole, at one of a few places that their lengths tell. Buckets are counted first; pairs are
made in those of few lines alone. The lines of crowded buckets are dealt again by all of the line but t of some cells, so
that what a bucket's lines may differ in is a small part of them. Where for one edit such a bucket is still crowded, its
lines meet by all of the line but one character: lines that agree in that are within one edit, so the smallest place of a
group tells all its members whether they have an earlier near line, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.base import WORD, pick, text_of
from palimpsest.session import stash

THRESHOLD = 1
#: lines with fewer code points are compared exactly only, and stay as they are if blank
LEAST = 20
#: cells of a line by threshold: all but ``threshold`` of them are one key
CELLS = {1: 16, 2: 8}
#: lines in a bucket from which it is dealt again
HOT = 24
#: up to so many line ids (16 bytes each) are sent to every task; beyond, the join shuffles
SENT = 100_000


def exempt(line: Column) -> Column:
    """Whether a line is short and blank: it takes no part and always stays."""
    return (F.length(line) < LEAST) & ~line.rlike(WORD)


def part(line: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` up to ``end``, from 0."""
    return F.substring(line, (start + 1).cast("int"), (end - start).cast("int"))


def segments(line: Column, length: Column, threshold: int) -> tuple[list[Column], list[Column]]:
    """Hashes of all segments as the index has them, and of what a line as long or up to ``threshold`` longer than an indexed
    one would match, where that isn't an index hash already.

    Of t edits, if segment i is the first that is whole, i at most are before it and t - i behind, as each segment without
    an edit before it would be the first; so its place is shifted by at most i, and by at most t - i as seen from the end.
    """
    k = threshold + 1

    def one(size: Column, i: int, shift: int) -> Column:
        start, end = F.floor(size * i / k), F.floor(size * (i + 1) / k)
        return F.xxhash64(size, F.lit(i), part(line, start + shift, end + shift))

    index = [one(length, i, 0) for i in range(k)]
    probes = [
        one(length - more, i, shift)
        for more in range(threshold + 1)
        for i in range(k)
        for shift in range(-i, i + 1)
        if abs(shift - more) <= threshold - i and (more or shift)
    ]
    return index, probes


def shifts(threshold: int, more: int) -> list[list[int]]:
    """How far what stands between ``threshold`` places of edits can be shifted, at the end by ``more``."""
    found = [[0]]
    for _ in range(threshold):
        found = [[*f, s] for f in found for s in range(-threshold, threshold + 1)]
    cost = lambda f: sum(abs(x - y) for x, y in zip(f, f[1:], strict=False))
    return [f for f in found if f[-1] == more and cost(f) <= threshold]


def cells(line: Column, length: Column, threshold: int) -> Column:
    """Array of ``sig, indexed``: hashes of the line without ``threshold`` cells, as lines up to ``threshold`` shorter have them."""
    n, out = CELLS[threshold], []
    for more in range(threshold + 1):
        size = length - more
        edge = lambda j, size=size: F.floor(size * j / n)
        for left in combinations(range(n), threshold):
            for shift in shifts(threshold, more):
                bounds = [(0 if k == 0 else left[k - 1] + 1, n if k == threshold else left[k]) for k in range(threshold + 1)]
                kept = [part(line, edge(a) + s, edge(b) + s) for (a, b), s in zip(bounds, shift, strict=True)]
                indexed = more == 0 and not any(shift)
                out.append(F.struct(F.xxhash64(size, F.lit(repr(left)), *kept).alias("sig"), F.lit(indexed).alias("indexed"), F.lit(left[0]).alias("cell"), F.lit(more).alias("more")))
    return F.array(*out)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two arrays of code points, each longer than ``threshold``, are within so many edits.

    Bit-parallel on a band: bit r of a number stands for the row that is r - threshold below the diagonal, so 2 * threshold
    + 1 bits hold all that matters of a column. Along the diagonal the score rises where a step isn't free; once the band
    reaches the last row, the score follows that row.
    """
    width = 2 * threshold + 1
    every = (1 << width) - 1
    no = lambda x: F.lit(every).cast("long") - x
    bit = lambda x, k: F.shiftright(x, k).bitwiseAND(F.lit(1).cast("long"))
    n, m = F.size(a), F.size(b)
    start = F.struct(F.lit(every - ((1 << threshold) - 1)).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(threshold).cast("long").alias("d"))

    def step(acc: Column, i: Column) -> Column:
        here = F.get(b, i)
        same = sum((F.when(F.get(a, i + (r - threshold)) == here, F.lit(1 << r)).otherwise(F.lit(0)) for r in range(width)), F.lit(0)).cast("long")

        def with_same(x: Column) -> Column:
            flat = ((x.bitwiseAND(acc["up"]) + acc["up"]).bitwiseXOR(acc["up"])).bitwiseOR(x).bitwiseOR(acc["down"]).bitwiseAND(F.lit(every).cast("long"))
            return let(flat, with_flat)

        def with_flat(flat: Column) -> Column:
            return let(F.struct(flat.alias("flat"), acc["down"].bitwiseOR(no(flat.bitwiseOR(acc["up"]))).alias("rise"), flat.bitwiseAND(acc["up"]).alias("fall")), with_all)

        def with_all(x: Column) -> Column:
            after = F.shiftright(x["flat"], 1)
            last = (F.lit(2 * threshold - 1) - (i - (n - threshold))).cast("int")  # where the last row is in the band
            moved = F.when(i < n - threshold, F.lit(1) - bit(x["flat"], 2 * threshold)).otherwise(
                F.expr("0L") + F.call_function("shiftright", x["rise"], last).bitwiseAND(F.lit(1).cast("long")) - F.call_function("shiftright", x["fall"], last).bitwiseAND(F.lit(1).cast("long"))
            )
            return F.struct(x["fall"].bitwiseOR(no(after.bitwiseOR(x["rise"]))).alias("up"), after.bitwiseAND(x["rise"]).alias("down"), (acc["d"] + moved).cast("long").alias("d"))

        return let(same, with_same)

    far = F.abs(n - m) > threshold
    return F.when(far, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(0), m - 1), start, step, lambda acc: acc["d"] <= threshold))


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, row, pos, line, h1, h2`` of every line that takes part; ``row`` tells apart unequal rows with one doc_id."""
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(~exempt(F.col("line")))
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def bucketed(rows: DataFrame, name: str) -> DataFrame:
    """Rows ``sig, indexed, h1, h2`` (and others) of buckets in which different lines meet, with ``lines``, the rows of the
    bucket. Buckets are counted, and what is left of them joined, so no task needs all rows of one."""
    sums = rows.groupBy("sig").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("indexed").alias("any_index"), F.count("*").alias("lines"))
    counted = stash(sums.filter((F.col("low") != F.col("high")) & F.col("any_index")).select("sig", "lines"), name)
    return rows.join(F.broadcast(counted) if counted.count() <= SENT else counted, "sig")


def met(rows: DataFrame) -> DataFrame:
    """Pairs of different lines in a bucket, an indexed one with any, each pair once."""
    a = rows.filter("indexed").select("sig", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    b = rows.select("sig", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("indexed").alias("both"))
    pairs = a.join(b, "sig").filter("(a1 <> b1 or a2 <> b2) and (not both or a1 < b1 or (a1 = b1 and a2 < b2))")
    return pairs.select("a1", "a2", "b1", "b2").distinct()


def crowded(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``h1, h2`` of lines that have an earlier one within one edit among ``rows(h1, h2, cell, more)``: lines of crowded
    buckets, which agree in all but one cell.

    A line gives all of itself but one character of the cell, and as a longer one what a shorter line would be; as a shorter
    one itself. Of lines that agree in all but one character all but the first have an earlier near one, so groups are
    judged by their smallest place.
    """
    n = CELLS[1]
    df = rows.select("h1", "h2", "cell", "more").distinct().join(texts.select("h1", "h2", "place", "line"), ["h1", "h2"]).withColumn("length", F.length("line"))
    size = F.col("length") - F.col("more")
    df = df.withColumn("start", F.floor(size * F.col("cell") / n)).withColumn("end", F.floor(size * (F.col("cell") + 1) / n) + F.col("more"))
    line, length = F.col("line"), F.col("length")

    def without(at: Column) -> Column:
        rest = [part(line, F.lit(0), at), part(line, at + 1, length)]
        kind = F.when(F.col("more") == 0, at).otherwise(F.lit(-1))  # a character changed at a place, or one too many anywhere
        whole = F.concat(*rest)
        return F.struct(kind.alias("kind"), F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2"), F.lit(False).alias("itself"))

    itself = F.struct(F.lit(-1).cast("long").alias("kind"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(True).alias("itself"))
    shorter = F.when(F.col("end") > F.col("start"), F.transform(F.sequence(F.col("start"), F.col("end") - 1), without))
    given = F.concat(F.coalesce(shorter, F.array().cast("array<struct<kind:bigint,k1:bigint,k2:bigint,itself:boolean>>")), F.when(F.col("more") == 0, F.array(itself)).otherwise(F.array().cast("array<struct<kind:bigint,k1:bigint,k2:bigint,itself:boolean>>")))
    keyed = stash(df.select("h1", "h2", "place", F.inline(given)).distinct(), "characters")
    keys = ["kind", "k1", "k2"]
    own = F.when(F.col("itself"), F.col("place"))
    other = F.when(~F.col("itself"), F.col("place"))
    firsts = keyed.groupBy(*keys).agg(F.min(own).alias("own"), F.min(other).alias("other"), F.count("*").alias("n")).filter("n > 1").drop("n")
    judged = keyed.join(firsts, keys)
    near = F.when(F.col("kind") >= 0, F.col("other") < F.col("place")).when(F.col("itself"), F.col("other") < F.col("place")).otherwise(F.col("own") < F.col("place"))
    return judged.filter(near).select("h1", "h2").distinct()


def first_lines(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """All different lines with the place where each comes first, and those of them that have an earlier near line."""
    lines = occurrences(docs)
    length = F.length("line")
    index, probes = segments(F.col("line"), length, threshold)
    named = [f"s{i}" for i in range(len(index))] + [f"p{i}" for i in range(len(probes))]
    hashed = lines.select("doc_id", "row", "pos", "h1", "h2", length.alias("length"), *[c.alias(n) for c, n in zip([*index, *probes], named, strict=True)])
    place = F.min(F.struct("doc_id", "pos", "row")).alias("place")
    first = stash(hashed.groupBy("h1", "h2", "length", *named).agg(place), "lines")
    sigs = F.array(*[F.struct(F.col(n).alias("sig"), F.lit(n[0] == "s").alias("indexed")) for n in named])
    shared = stash(bucketed(first.filter(F.col("length") >= LEAST).select(F.inline(sigs), "h1", "h2"), "counts"), "segments")
    # texts of the lines that met another one, each from the place where it is first
    wanted = stash(first.join(shared.groupBy("h1", "h2").agg(F.max("lines").alias("lines")), ["h1", "h2"]).select("h1", "h2", "place", "lines"), "wanted")
    small = wanted.count() <= SENT
    at = (F.col("o.h1") == F.col("w.h1")) & (F.col("o.h2") == F.col("w.h2")) & (F.col("w.place.doc_id").eqNullSafe(F.col("o.doc_id"))) & (F.col("w.place.row") == F.col("o.row")) & (F.col("w.place.pos") == F.col("o.pos"))
    found = lines.alias("o").join((F.broadcast(wanted) if small else wanted).alias("w"), at).select("w.h1", "w.h2", "w.place", "w.lines", "o.line")
    texts = stash(found.dropDuplicates(["h1", "h2"]), "texts")
    pairs = met(shared.filter(F.col("lines") <= HOT))
    hot = texts.filter(F.col("lines") > HOT)
    dealt = hot.select("h1", "h2", F.inline(cells(F.col("line"), F.length("line"), threshold)))
    dealt = stash(bucketed(dealt, "cell counts"), "cells")
    pairs = pairs.unionByName(met(dealt.filter(F.col("lines") <= HOT) if threshold == 1 else dealt)).distinct()
    points = lambda name: F.filter(F.split(name, ""), lambda c: c != "").alias(name)
    a = texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("place").alias("a_place"), F.col("line").alias("a"))
    b = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("place").alias("b_place"), F.col("line").alias("b"))
    both = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    both = both.select("a1", "a2", "b1", "b2", (F.col("a_place") > F.col("b_place")).alias("a_later"), F.inline(F.array(F.struct(points("a"), points("b")))))
    near = both.filter(within(F.col("a"), F.col("b"), threshold))
    later = near.select(F.when(F.col("a_later"), F.col("a1")).otherwise(F.col("b1")).alias("h1"), F.when(F.col("a_later"), F.col("a2")).otherwise(F.col("b2")).alias("h2"))
    if threshold == 1:
        later = later.unionByName(crowded(dealt.filter(F.col("lines") > HOT), texts))
    return first, stash(later.distinct(), "near")


def line_dedup(docs: DataFrame, others: tuple[str, ...] = (), threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, row, n_lines, n_exact, n_near, kept`` for each row of ``docs(doc_id, text)``; ``kept`` is the text that stays.

    Columns named in ``others`` come along, called ``other_0`` and so on.

    Lines are parts between newlines. A line is dropped if the same line comes earlier, by (doc_id, place in the text);
    one of ``LEAST`` code points or more also if one within an edit distance of ``threshold`` (1 or 2), of as many points at least, does.
    ``n_exact`` counts dropped lines whose own text came earlier, ``n_near`` those that only a near line preceded. Blank
    lines of fewer points always stay. A null or empty text has one empty line and stays; null ids come first. Rows
    repeated whole keep the same lines each. Lines are compared whole however long; columns that aren't named, also ones
    with clashing names, are left. An empty table gives an empty one. With 1 no pairs are made of crowded buckets at all;
    with 2 lines that agree in all but two of eight cells meet in pairs.
    """
    if threshold not in CELLS:
        raise ValueError(f"lines are compared within {' or '.join(map(str, CELLS))} edits, not {threshold}")
    held = [f"other_{i}" for i in range(len(others))]
    docs = pick(docs, "doc_id", "text", *others).toDF("doc_id", "text", *held)
    first, later = first_lines(docs.select("doc_id", "text"), threshold)
    alone = first.join(later.withColumn("near", F.lit(True)), ["h1", "h2"], "left").select("place.doc_id", "place.row", "place.pos", F.coalesce("near", F.lit(False)).alias("near"))
    by_row = alone.groupBy("doc_id", "row").agg(F.collect_list(F.when(~F.col("near"), F.col("pos"))).alias("stay"), F.count_if("near").alias("n_near"))
    rows = docs.select("doc_id", text_of().alias("text"), *held).withColumn("row", F.xxhash64("doc_id", "text"))
    joined = rows.alias("d").join(by_row.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.row") == F.col("k.row")), "left")
    joined = joined.select("d.doc_id", "d.row", *held, F.split("text", "\n").alias("lines"), F.coalesce("stay", F.array().cast("array<int>")).alias("stay"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    blank = F.filter(F.transform("lines", lambda line, i: F.when(exempt(line), i)), lambda i: i.isNotNull())
    joined = joined.withColumn("at", F.sort_array(F.array_union("stay", blank)))
    n = F.size("lines").cast("long")
    return joined.select(
        "doc_id", "row", *held, n.alias("n_lines"), (n - F.size("at") - F.col("n_near")).cast("long").alias("n_exact"), "n_near",
        F.array_join(F.transform("at", lambda i: F.get("lines", i)), "\n").alias("kept"),
    )
