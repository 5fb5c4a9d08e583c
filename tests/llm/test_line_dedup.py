import random
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import line_dedup as module
from palimpsest.llm.line_dedup import line_dedup
from palimpsest.llm.queries import QUERIES
from tests.llm.helpers import DOC_SCHEMA, edge_docs, empty_docs


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def within_two(a, b):
    if abs(len(a) - len(b)) > 2:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1] <= 2


def brute(docs, close=within_one):
    """docs: (doc_id, text), ids differ. For each id: lines, exact, near, kept text. Short lines take part in exact repeats
    only, and not at all if blank."""
    least, first, out = module.LEAST, {}, {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for pos, line in enumerate((text or "").split("\n")):
            if len(line) >= least or line.strip(" \t\n\v\f\r"):
                first.setdefault(line, (doc_id is not None, doc_id or 0, pos))
    by_length = {}
    for line in first:
        by_length.setdefault(len(line), []).append(line)
    near = {s for s in first if len(s) >= least and any(t != s and first[t] < first[s] and close(s, t) for n in range(-2, 3) if len(s) + n >= least for t in by_length.get(len(s) + n, []))}
    for doc_id, text in docs:
        lines, stay, n_near = (text or "").split("\n"), [], 0
        for pos, line in enumerate(lines):
            here = first.get(line) == (doc_id is not None, doc_id or 0, pos)
            if line not in first or (here and line not in near):
                stay.append(line)
            n_near += here and line in near
        out[doc_id] = (len(lines), len(lines) - len(stay) - n_near, n_near, "\n".join(stay))
    return out


def result(df):
    return {r["doc_id"]: (r["n_lines"], r["n_exact"], r["n_near"], r["kept"]) for r in df.collect()}


def test_op7_over_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = brute(docs)
    got = {r["doc_id"]: (r["n_lines"], r["n_exact"], r["n_near"], r["kept_chars"], r["kept_crc32"]) for r in QUERIES["op7_line_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (*w[:3], len(w[3]), zlib.crc32(w[3].encode())) for i, w in want.items()}
    assert sum(w[1] for w in want.values()) > 0


def variants(seed, n):
    rng, letters = random.Random(seed), "abcdé ñ"
    bases = ["".join(rng.choice(letters) for _ in range(k)) for k in (19, 20, 21, 22, 40, 75)]
    out = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
            lines.append("".join(line))
        out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize(("seed", "hot", "sent"), [(1, 24, 100_000), (2, 2, 100_000), (3, 2, 0), (4, 10**9, 0)])
def test_variants(spark, monkeypatch, seed, hot, sent):
    monkeypatch.setattr(module, "HOT", hot)
    monkeypatch.setattr(module, "SENT", sent)
    docs = variants(seed, 150)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOC_SCHEMA)
    want = brute(docs)
    assert result(line_dedup(df)) == want
    assert sum(w[2] for w in want.values()) > 10


@pytest.mark.parametrize(("seed", "hot", "sent"), [(5, 24, 100_000), (6, 2, 0)])
def test_variants_within_two_edits(spark, monkeypatch, seed, hot, sent):
    monkeypatch.setattr(module, "HOT", hot)
    monkeypatch.setattr(module, "SENT", sent)
    docs = [(i, t) for i, t in variants(seed, 120)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOC_SCHEMA)
    want = brute([(i, t) for i, t in docs], within_two)
    assert result(line_dedup(df, threshold=2)) == want
    assert sum(w[2] for w in want.values()) > 10


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_distance_on_a_band(spark, threshold):
    rng, rows = random.Random(threshold), []
    for _ in range(3000):
        a = [rng.choice("abcé🙂") for _ in range(rng.randint(4, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        if len(b) > threshold:
            rows.append(("".join(a), "".join(b)))
    points = lambda c: F.split(c, "").alias(f"c{c}")
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.inline(F.array(F.struct(points("a"), points("b")))))
    assert df.filter(module.within(F.col("ca"), F.col("cb"), threshold) != (F.levenshtein("a", "b") <= threshold)).count() == 0


def counters(n, first=0):
    rng = random.Random(1)
    head, tail = ("".join(rng.choice("abcdefgh ") for _ in range(70)) for _ in range(2))
    return [(i, f"{head}{first + k}{tail}") for i, k in enumerate(rng.sample(range(n), n))]


def test_lines_that_differ_in_a_number(spark):
    """All of one cell: no pairs are made of them."""
    docs = counters(2000) + [(9000 + i, t[:100] + t[101:]) for i, t in counters(40)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOC_SCHEMA)
    assert result(line_dedup(df)) == brute(docs)


def test_crowded_lines_take_work_in_proportion(spark, monkeypatch):
    written = {}
    stash = module.stash

    def counted(df, name, *rest):
        out = stash(df, name, *rest)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(module, "stash", counted)
    rows = {}
    for n in (2000, 8000):
        written.clear()
        df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in counters(n, 10_000)], DOC_SCHEMA)
        assert line_dedup(df).count() == n
        rows[n] = sum(written.values())
    assert rows[8000] < 4.5 * rows[2000]


def test_lines_of_a_megabyte(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abc ") for _ in range(1_000_000))
    docs = [(1, long), (2, long[:500_000] + "X" + long[500_001:]), (3, long[:-2]), (4, f"{long}\n{long[1:]}")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOC_SCHEMA)
    assert {i: r[:3] for i, r in result(line_dedup(df)).items()} == {1: (1, 0, 0), 2: (1, 0, 1), 3: (1, 0, 0), 4: (2, 1, 1)}


def test_edges(spark):
    rows = edge_docs(spark)
    got = line_dedup(rows)
    assert got.count() == rows.count()
    by_id = result(got)
    assert by_id[0] == (1, 0, 0, "") and by_id[1] == (1, 0, 0, "") and by_id[None][0] == 1
    assert line_dedup(empty_docs(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a line of more than twenty characters", "en", "s", 1)] * 2, DOC_SCHEMA)
    assert [r["n_exact"] for r in line_dedup(twice).collect()] == [0, 0]


@pytest.mark.parametrize("threshold", [0, 3])
def test_thresholds_that_are_not_there(spark, threshold):
    with pytest.raises(ValueError, match="within 1 or 2 edits"):
        line_dedup(empty_docs(spark), threshold=threshold)
