import hashlib
from collections import Counter, defaultdict

import pytest
from tests.llm.helpers import edge_docs, empty_docs
from pyspark.sql import functions as F

from palimpsest.llm.snapshot import later_documents, run_ranks, snapshot_diff

SCHEMA = "doc_id long, text string, lang string, source string"


def sha(row):
    return hashlib.sha256("\n".join("~" if v is None else v for v in row).encode()).hexdigest()


def brute(earlier, later):
    """The diff by plain loops, for unique keys."""
    old, new = {r[0]: r[1:] for r in earlier}, {r[0]: r[1:] for r in later}
    out = []
    for k in old.keys() & new.keys():
        changed = ",".join(c for c, a, b in zip(("text", "lang", "source"), old[k], new[k], strict=True) if a != b)
        out.append((k, k, "update" if changed else "same", changed, sha(new[k])))
    left, right = defaultdict(list), defaultdict(list)
    for k in old.keys() - new.keys():
        left[old[k]].append(k)
    for k in new.keys() - old.keys():
        right[new[k]].append(k)
    for content in left.keys() | right.keys():
        a, b = sorted(left[content]), sorted(right[content], reverse=True)
        n = min(len(a), len(b))
        out += [(y, x, "rekey", "", sha(content)) for x, y in zip(a[:n], b[:n], strict=True)]
        out += [(x, x, "delete", "", None) for x in a[n:]] + [(y, None, "insert", "", sha(content)) for y in b[n:]]
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("key", "old_key", "op", "changed", "row_sha256").collect())


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_against_brute_force(spark, parts):
    """A third of all rows has one text; many keys change on both sides."""
    earlier = [(i, None if i % 7 == 0 else "hot" if i % 3 == 0 else f"t{i % 50}", ["a", None][i % 2], "s") for i in range(900)]
    later = [(-1 - k if k % 4 == 0 else k, t, g, s) for k, t, g, s in earlier if k % 11] + [(5_000 + i, "hot", "a", "s") for i in range(200)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert got(snapshot_diff(spark.createDataFrame(earlier, SCHEMA), spark.createDataFrame(later, SCHEMA))) == brute(earlier, later)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_ranks_of_runs_that_cross_parts(spark):
    rows = [("hot" if i % 3 else f"r{i % 40}", i % 2, i) for i in range(3_000)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        df = spark.createDataFrame(rows, "run string, side int, i long")
        found = {(r["run"], r["side"], r["i"]): r["rank"] for r in run_ranks(df, ["run", "side"], [F.col("i").desc()]).collect()}
        assert run_ranks(df.limit(0), ["run", "side"], [F.col("i")]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    groups = defaultdict(list)
    for run, side, i in rows:
        groups[run, side].append(i)
    assert found == {(*k, i): n + 1 for k, own in groups.items() for n, i in enumerate(sorted(own, reverse=True))}


def test_nulls_repeats_and_clashing_columns(spark):
    docs = edge_docs(spark)
    rows = docs.count()
    same = Counter(r["op"] for r in snapshot_diff(docs, docs).collect())
    assert same == {"same": rows}  # a null key pairs with a null key, a repeated row with its like
    assert Counter(r["op"] for r in snapshot_diff(docs, empty_docs(spark)).collect()) == {"delete": rows}
    assert Counter(r["op"] for r in snapshot_diff(empty_docs(spark), docs).collect()) == {"insert": rows}
    assert snapshot_diff(empty_docs(spark), empty_docs(spark)).count() == 0
    found = snapshot_diff(docs, later_documents(docs)).collect()
    assert sum(r["old_key"] is not None or r["op"] in ("same", "update", "rekey", "delete") for r in found) >= rows - 1
    assert {r["op"] for r in found} <= {"same", "update", "rekey", "insert", "delete"}


def test_repeated_keys_count_off(spark):
    one = spark.createDataFrame([(1, "a", "x", "s")] * 3 + [(2, "b", None, "s")], SCHEMA)
    two = spark.createDataFrame([(1, "a", "x", "s")] * 2 + [(9, "a", "x", "s"), (2, "b", "~", "s")], SCHEMA)
    assert got(snapshot_diff(one, two)) == Counter(
        [(1, 1, "same", "", sha(("a", "x", "s")))] * 2 + [(9, 1, "rekey", "", sha(("a", "x", "s"))), (2, 2, "update", "lang", sha(("b", "~", "s")))]
    )  # null and '~' differ though their digests are of the same bytes


def test_columns_do_not_run_into_each_other(spark):
    one = spark.createDataFrame([(1, "a\nb", "c", None), (2, "a", None, "c")], SCHEMA)
    two = spark.createDataFrame([(3, "a", "b\nc", None), (4, "a", "c", None)], SCHEMA)
    assert Counter(r["op"] for r in snapshot_diff(one, two).collect()) == {"delete": 2, "insert": 2}


def test_texts_of_some_megabytes(spark):
    long = "word " * 800_000
    one, two = spark.createDataFrame([(1, long, "x", "s"), (2, long, "x", "s")], SCHEMA), spark.createDataFrame([(1, long + "!", "x", "s"), (7, long, "x", "s")], SCHEMA)
    assert {(r["key"], r["old_key"], r["op"], r["changed"]) for r in snapshot_diff(one, two).collect()} == {(1, 1, "update", "text"), (7, 2, "rekey", "")}
