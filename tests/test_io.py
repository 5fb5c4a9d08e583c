"""Round trips through trees of files."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from palimpsest.operators import curation, layout, scoring
from palimpsest.sinks import files as sinks
from palimpsest.sources import files as sources
from palimpsest.streaming import incremental


def write(path: Path, content="fake"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_pair_trees(spark, tmp_path):
    write(tmp_path / "pred/a/x_1.md", " le chat \n\n noir\n")
    write(tmp_path / "pred/root.md", "r")
    write(tmp_path / "pred/a/only.md", "z")
    write(tmp_path / "lab/a/x_1.txt", "le chat\nnoir")
    write(tmp_path / "lab/root.txt", "r")
    pairs, _ = scoring.collect_pairs(*sources.pair_trees(spark, str(tmp_path / "pred"), str(tmp_path / "lab")))
    assert sorted((r["subfolder"], r["stem"], r["prediction"]) for r in pairs.collect()) == [("", "root", "r"), ("a", "x_1", "le chat\nnoir")]


def test_images(spark, tmp_path):
    for name in ("b.jpg", "a.png", "c.JPG", "d.txt", "lines/e.jpeg"):
        write(tmp_path / "in dir+x" / name)
    base = str(tmp_path / "in dir+x")
    assert [r["path"].split("/")[-1] for r in sources.images(spark, base).collect()] == ["a.png", "b.jpg", "e.jpeg"]
    assert sources.images(spark, base, limit=1).count() == 1 and sources.images(spark, base, limit=0).count() == 3
    assert sources.images(spark, base, recursive=False).count() == 2 and sources.images_any_case(spark, base).count() == 4
    assert [r["path"].split("/")[-1] for r in sources.line_images(spark, base).collect()] == ["e.jpeg"]


def crop_tree(base):
    for split, page, k in (("train", "p1", 1), ("test", "p1", 2), ("dev", "p1", 3), ("train", "p2", 1)):
        write(base / split / "images" / "sub" / f"{page}_{k}.jpg")
        if k != 2:
            write(base / split / "labels" / "sub" / f"{page}_{k}.txt", f" text {page} {k}\n")


def test_crops_and_annotations(spark, tmp_path):
    crop_tree(tmp_path / "ocr")
    crops = sources.split_crops(spark, str(tmp_path / "ocr"))
    got = {(r["split"], r["subfolder"], r["filename"]): r["text"] for r in crops.collect()}
    assert got == {("train", "sub", "p1_1.jpg"): "text p1 1", ("test", "sub", "p1_2.jpg"): "", ("dev", "sub", "p1_3.jpg"): "text p1 3", ("train", "sub", "p2_1.jpg"): "text p2 1"}
    paged = curation.first_wins(crops).withColumn("page", F.regexp_extract("filename", "^(.*)_", 1))
    assert curation.regroup(paged).count() == 2
    sinks.write_annotations(crops.select("filename", "subfolder", "text", F.when(F.col("split") != "train", F.col("split")).alias("split")), str(tmp_path / "ann"))
    back = spark.read.json(str(tmp_path / "ann"))
    assert {r["split"]: r["count"] for r in back.groupBy("split").count().collect()} == {"train": 2, "test": 1, "dev": 1}
    for split in ("train", "dev"):
        write(tmp_path / "json" / split / "annotations.json", json.dumps([{"filename": f"{split}.jpg", "text": "t"}]))
    assert {(r["filename"], r["split"]) for r in sources.split_annotations(spark, str(tmp_path / "json")).collect()} == {("train.jpg", "train"), ("dev.jpg", "dev")}
    write(tmp_path / "old/images/a.jpg")
    write(tmp_path / "old/images/b.jpg")
    write(tmp_path / "old/labels/a.txt", "hello")
    assert [r["filename"] for r in sources.legacy_annotations(spark, str(tmp_path / "old")).collect()] == ["a.jpg"]


def test_labels(spark, tmp_path):
    write(tmp_path / "lab/a.txt", "0 0.5 0.5 0.2 0.2\n\n1 0.1 0.1 0.1 0.1\n")
    write(tmp_path / "lab/b.txt", "Plein Texte 1 2 3 4\nNope 1 2 3 4\n7 5 6 7 8")
    assert sources.yolo_labels(spark, str(tmp_path / "lab")).filter("stem = 'a'").count() == 2
    row = sources.detection_rows(spark, str(tmp_path / "lab"), {"Plein Texte": 4}).filter("file_name = 'b.jpg'").first()
    assert row["objects"]["categories"] == [4, 7] and row["objects"]["bbox"][1] == [5, 6, 7, 8]
    sinks.write_detection_metadata(sources.detection_rows(spark, str(tmp_path / "lab"), {"Plein Texte": 4}), str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).count() == 2
    write(tmp_path / "folder/metadata.jsonl", '{"file_name": "a.jpg", "k": 1}\n')
    write(tmp_path / "folder/a.jpg")
    assert sources.image_folder(spark, str(tmp_path / "folder")).first()["k"] == 1


def test_manifest_reports_and_transcripts(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.jpg", "r", "é «x»"), ("c.jpg", "r", "y")], "image string, region string, text string")
    sinks.write_manifest(rows, str(tmp_path / "m"))
    assert "é «x»" in "".join(p.read_text() for p in (tmp_path / "m").glob("part-*"))
    assert {r["image_path"] for r in sources.manifest(spark, str(tmp_path / "m"), "/root/x/").collect()} == {"/root/x/a/b.jpg", "/root/x/c.jpg"}
    items = scoring.item_metrics(spark.createDataFrame([("s", "1", "ab", "ab")], "subfolder string, stem string, prediction string, reference string"))
    sinks.write_report(scoring.nested_report(items), str(tmp_path / "r"))
    assert sources.report_stats(spark, str(tmp_path / "r")).first()["n"] == 1
    texts = spark.createDataFrame([("p1", "t"), ("p2", "t")], "path string, text string")
    for part in (texts.limit(1), texts):
        sinks.append_transcripts(part, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    results = spark.createDataFrame([("a", 1, 2, None), ("b", 0, 0, "boom")], "path string, input_tokens long, output_tokens long, error string")
    sinks.write_summary(results, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/summary")).first()["failed"] == 1 and spark.read.json(str(tmp_path / "s/failed")).first()["path"] == "b"
    sinks.write_transcriptions(spark.createDataFrame([("l1.jpg", "a b")], "basename string, text string"), str(tmp_path / "tsv"))
    assert "l1.jpg\ta b" in "".join(p.read_text() for p in (tmp_path / "tsv").glob("part-*"))
    found = spark.createDataFrame([("i", 0, 4, "Plein Texte", 0.9, 1, 2, 3, 4)], "image string, seq int, class_id int, label string, confidence double, x int, y int, width int, height int")
    sinks.write_predictions(found, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first()["n_regions"] == 1
    splits = layout.dataset_splits(spark.createDataFrame([("train", 5), ("test", 2)], "split string, n long")).first().asDict()
    assert splits == {"train": "train", "val": "test", "test": "test"} and "val: images/test" in sinks.dataset_yaml("/d", splits, ["Title"])
    assert sinks.with_suffixes(texts, ["2"]).count() == 1 and sinks.with_suffixes(texts, None).count() == 2
    write(tmp_path / "schema.json", json.dumps({"parameters": {"properties": {"name": {}, "father's age": {}}}}))
    assert sources.entity_schema(sources.small_text(spark, str(tmp_path / "schema.json"))) == "struct<`name`:string,`father's age`:string>"


def test_sidecars(spark):
    found = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "subfolder string, stem string")
    beside = spark.createDataFrame([("s", "a", "1")], "subfolder string, stem string, text string")
    label = spark.createDataFrame([("s", "a", "2"), ("s", "b", "3")], "subfolder string, stem string, text string")
    assert {r["stem"]: r["text"] for r in sources.sidecars(found, beside, label).collect()} == {"a": "1", "b": "3", "c": ""}


def test_streams(spark, tmp_path):
    schema = "subfolder string, stem string, prediction string, reference string"
    for k in range(2):
        spark.createDataFrame([("s", str(k), "ab", "ab")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == k + 1
    write(tmp_path / "img/a.jpg")
    q = incremental.new_images(spark, str(tmp_path / "img")).select("path").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 1
