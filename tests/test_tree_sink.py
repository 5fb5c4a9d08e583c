import os
import threading

import pytest
from pyspark.sql import functions as F

from palimpsest.sinks import files as sinks
from palimpsest.sinks import tree

ROWS = "folder string, name string, content binary"


def there(base):
    return sorted(str(p.relative_to(base)) for p in base.rglob("*") if p.is_file()) if base.exists() else []


def test_repeated_names_are_written_once(spark, tmp_path):
    """A thousand names four times over, with different contents, from many tasks."""
    rows = spark.range(4_000, numPartitions=4).select(F.lit("d").alias("subfolder"), (F.col("id") % 1_000).cast("string").alias("stem"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    got = sinks.write_texts(rows, str(tmp_path / "out"))
    assert got.filter("written").count() == got.count() == 1_000
    files = there(tmp_path / "out")
    assert len(files) == 1_000
    for name in files[:50]:
        text = (tmp_path / "out" / name).read_text()
        assert text.startswith("text ") and int(text[5:]) % 1_000 == int(name[2:-3])
    before = {name: (tmp_path / "out" / name).read_text() for name in files}
    assert sinks.write_texts(rows, str(tmp_path / "out")).filter("written").count() == 0
    assert before == {name: (tmp_path / "out" / name).read_text() for name in there(tmp_path / "out")}


@pytest.mark.parametrize("folder, stem", [("..", "x"), ("a/../../b", "x"), ("", "../../esc"), ("/tmp", "x"), ("a", ""), ("_staging", "x"), ("a//b", "x")])
def test_names_elsewhere_are_an_error_and_nothing_is_written(spark, tmp_path, folder, stem):
    rows = spark.createDataFrame([(f"ok{i}", "x", b"1") for i in range(20)] + [(folder, stem, b"2")], ROWS).repartition(4)
    with pytest.raises(Exception, match="no name of a file"):
        tree.write_tree(rows, str(tmp_path / "deep" / "er" / "out"))
    assert [f for f in there(tmp_path) if "/_staging/" not in f] == []  # a task that is being killed may still stage


def test_empty_and_null_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", None), (None, "2", ""), ("a", "3", "x")], "subfolder string, stem string, text string")
    assert sinks.write_texts(rows, str(tmp_path)).filter("written").count() == 3
    assert there(tmp_path) == ["2.md", "a/1.md", "a/3.md"]
    assert sinks.write_texts(rows, str(tmp_path)).filter("written").count() == 0  # what is empty isn't written again
    assert sinks.write_texts(rows.withColumn("text", F.lit("new")), str(tmp_path)).filter("written").count() == 2  # but filled
    assert (tmp_path / "a" / "3.md").read_text() == "x"
    assert sinks.write_texts(rows.limit(0), str(tmp_path)).count() == 0


def test_attempts_that_are_not_committed_leave_nothing(spark, tmp_path):
    """Two attempts of each task, as speculation makes them, and one that dies half way."""
    import pyarrow as pa

    base = str(tmp_path / "out")
    writer = tree.TreeWriter(base, "run")
    batch = lambda content: pa.record_batch({"folder": ["d"] * 3, "name": ["a", "b", "c"], "content": [content] * 3})

    def dies():
        yield batch(b"half")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    twice: list = []
    threads = [threading.Thread(target=lambda c=c: twice.append(writer.write(iter([batch(c * 100_000)])))) for c in (b"x", b"y")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert there(tmp_path / "out" / "d") == []
    writer.commit([twice[0], None])
    assert tree.publish(spark, base, "run").count() == 3
    assert there(tmp_path / "out") == ["d/a", "d/b", "d/c"]
    contents = {(tmp_path / "out" / "d" / n).read_bytes() for n in "abc"}
    assert contents in ({b"x" * 100_000}, {b"y" * 100_000})


def test_a_run_that_breaks_after_its_commit_is_ended(spark, tmp_path):
    import pyarrow as pa

    base = str(tmp_path / "out")
    writer = tree.TreeWriter(base, "run")
    done = writer.write(iter([pa.record_batch({"folder": ["d", "e"], "name": ["a", "b"], "content": [b"1", b"2"]})]))
    writer.commit([done])
    os.makedirs(tmp_path / "out" / "d")
    os.rename(tmp_path / "out" / "_staging" / "run" / done.name / "00000000", tmp_path / "out" / "d" / "a")  # one was moved
    assert tree.publish(spark, base, "run").filter("written").count() == 2
    assert there(tmp_path / "out") == ["d/a", "e/b"] and not (tmp_path / "out" / "_staging").exists()


def test_moves(spark, tmp_path):
    for name in ("train/images/a/1.jpg", "train/labels/a/1.txt", "dev/images/b/2.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    moves = spark.createDataFrame([("train/images/a/1.jpg", "test/images/a/1.jpg"), ("train/labels/a/1.txt", "test/labels/a/1.txt"), ("none", "test/none"), ("dev/images/b/2.jpg",) * 2], "source string, target string")
    for _ in range(2):  # a second run finds them moved
        got = {r["source"]: r["moved"] for r in tree.move_files(moves, str(tmp_path)).collect()}
        assert got == {"train/images/a/1.jpg": True, "train/labels/a/1.txt": True, "none": False}
    assert there(tmp_path) == ["dev/images/b/2.jpg", "test/images/a/1.jpg", "test/labels/a/1.txt"]
    for bad, said in (([("a", "x"), ("b", "x")], "2 files for"), ([("dev/images/b/2.jpg", "../x")], "no name of a file"), ([("a", "b"), ("b", "c")], "moved to")):
        with pytest.raises(Exception, match=said):
            tree.move_files(spark.createDataFrame(bad, "source string, target string"), str(tmp_path))
    assert len(there(tmp_path)) == 3


def test_fifty_images_fifty_calls(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("struct<input_tokens:long,output_tokens:long,error:string>")
    def called(i):
        calls.add(1)
        return (i, 2 * i, "boom" if i % 10 == 0 else None)

    results = spark.range(50, numPartitions=4).select(F.concat(F.lit("p"), F.col("id")).alias("path"), called("id").alias("r")).select("path", "r.*")
    total = sinks.write_summary(results, str(tmp_path / "s")).first()
    assert calls.value == 50
    want = {"images": 50, "succeeded": 45, "failed": 5, "input_tokens": sum(range(50)), "output_tokens": 2 * sum(range(50))}
    assert total.asDict() == want == spark.read.json(str(tmp_path / "s/summary")).first().asDict()
    assert spark.read.json(str(tmp_path / "s/failed")).count() == 5
    sinks.write_summary(results.limit(0), str(tmp_path / "none"))
    assert spark.read.json(str(tmp_path / "none/summary")).first()["images"] == 0
