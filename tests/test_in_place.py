"""Listing by tasks, upserts in place, ordered output and state across runs."""

import os
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.sinks import partitions
from palimpsest.sources import files as sources
from palimpsest.sources import listing
from palimpsest.streaming import keyed


def write(path: Path, content=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_a_tree_is_listed_by_tasks(spark, tmp_path):
    names = ["a.jpg", "b.PNG", "deep/er/c.jpeg", "deep/er/d.txt", "deep/e [1]+%20.jpg", "_hidden/f.jpg", ".g.jpg", "é/h.png"] + [f"many/{i}/x.jpg" for i in range(60)]
    for name in names:
        write(tmp_path / name, name.encode())
    (tmp_path / "empty").mkdir()
    seen = lambda df: sorted(os.path.relpath(r["path"], tmp_path) for r in df.collect())
    want = sorted(n for n in names if n.endswith((".jpg", ".jpeg", ".png")) and not n.startswith(("_", ".")))
    assert seen(listing.listed(spark, str(tmp_path), "*.{jpg,jpeg,png}")) == want
    assert seen(listing.listed(spark, f"file://{tmp_path}", "*.{jpg,jpeg,png}", any_case=True)) == sorted([*want, "b.PNG"])
    assert seen(listing.listed(spark, str(tmp_path), "*.jpg", recursive=False)) == ["a.jpg"]
    assert listing.listed(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(FileNotFoundError):
        listing.listed(spark, str(tmp_path / "none"))
    rows = listing.listed(spark, str(tmp_path), "*.txt").collect()
    assert rows[0]["length"] == len("deep/er/d.txt") and rows[0]["modificationTime"] is not None
    got = listing.placed(listing.contents(listing.listed(spark, str(tmp_path), "*.jpg"), str(tmp_path)), str(tmp_path)).collect()
    assert {(r["subfolder"], r["stem"]): bytes(r["content"]).decode() for r in got}["deep", "e [1]+%20"] == "deep/e [1]+%20.jpg"


def test_texts_are_those_of_the_file_source(spark, tmp_path):
    for name, text in (("a/1.md", " one\n"), ("2.md", "zwei é"), ("a/b/3.md", "x" * 100_000), ("a/4.txt", "no")):
        write(tmp_path / name, text.encode())
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(listing.texts(spark, str(tmp_path), ".md")) == rows(sources.texts(spark, str(tmp_path), ".md"))


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "filename string, text string, v long, split string"
    old = [(f"f{i}", f"t{i}", i, ["train", "test", "dev", None][i % 4]) for i in range(40)] + [("alone", "t", 1, "only")]
    spark.createDataFrame(old, schema).write.partitionBy("split").parquet(path)
    times = lambda split: {p.name: (p.stat().st_mtime_ns, p.stat().st_ino) for p in (tmp_path / "t" / f"split={split}").glob("*.parquet")}
    before = times("test"), times("__HIVE_DEFAULT_PARTITION__")
    new = [("f0", "new", 5, "train"), ("f0", "newer", 6, "train"), ("alone", "moved", 2, "dev"), ("fresh", "n", 1, "train")]
    assert partitions.upsert_partitions(spark, path, spark.createDataFrame(new, schema), ["filename"], "v", "split") == ["dev", "only", "train"]
    assert before == (times("test"), times("__HIVE_DEFAULT_PARTITION__"))
    want = {r[0]: r[1:] for r in old} | {"f0": ("newer", 6, "train"), "alone": ("moved", 2, "dev"), "fresh": ("n", 1, "train")}
    assert {r["filename"]: (r["text"], r["v"], r["split"]) for r in spark.read.schema(schema).parquet(path).collect()} == want
    assert not (tmp_path / "t" / "split=only").exists()
    assert partitions.upsert_partitions(spark, path, spark.createDataFrame([], schema), ["filename"], "v", "split") == []


def test_files_read_by_name_are_in_order(spark, tmp_path):
    path = str(tmp_path / "o")
    df = spark.range(5_000, numPartitions=7).select((F.hash("id") % 1_000).alias("k"), "id")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files even of few rows
    try:
        partitions.write_ordered(df, path, F.col("k").desc(), "id")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    files = sorted((tmp_path / "o").glob("part-*"))
    rows = [(-r["k"], r["id"]) for f in files for r in pq.read_table(f).to_pylist()]
    assert len(files) > 1 and rows == sorted(rows) and len(rows) == 5_000
    back = partitions.read_ordered(spark, path).orderBy("file", "row").collect()
    assert [(-r["k"], r["id"]) for r in back] == rows


@pytest.mark.parametrize("cap", [1, 3])
def test_three_runs_give_what_one_gives(spark, tmp_path, cap):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(600)]
    frame = lambda part: keyed.text_keys(spark.createDataFrame(part, "doc_id long, text string"))
    schema = frame(rows[:1]).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    run = lambda base, name: keyed.curate_new(spark, str(base), schema, str(tmp_path / name / "out"), str(tmp_path / name / "cp"), ["h1", "h2"], "doc_id", cap).awaitTermination()
    for k in range(3):
        frame(rows[200 * k : 200 * (k + 1)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "parts"))
        run(tmp_path / "parts", "three")
    frame(rows).coalesce(1).write.parquet(str(tmp_path / "all"))
    run(tmp_path / "all", "one")
    got = [sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / n / "out")).collect()) for n in ("three", "one")]
    want, seen = [], {}
    for i, text in rows:
        seen[text] = seen.get(text, 0) + 1
        if seen[text] <= cap:
            want.append(i)
    assert got[0] == got[1] == want
