"""Trees are listed and read by tasks, however many files a folder has; Spark's sources hold every file on the driver."""

from palimpsest.sources import files as sources
from palimpsest.sources import listing


def many(folder, n):
    folder.mkdir(parents=True)
    for i in range(n):
        (folder / f"{i:03}.txt").write_text(f" 0 0.5 0.5 0.25 {i / 1000:.3f}\r\nodd line\n")


def test_a_folder_is_read_by_many_tasks(spark, tmp_path):
    many(tmp_path / "t" / "labels", 100)
    files = listing.listed(spark, str(tmp_path), "*.txt")
    assert listing.contents(files, str(tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_sources_leave_no_listing_to_the_driver(spark, tmp_path):
    many(tmp_path / "t" / "labels", 20)
    (tmp_path / "t" / "images").mkdir()
    (tmp_path / "t" / "images" / "a+b %.PNG").write_bytes(b"x")
    base = (tmp_path / "t").as_uri()
    found = sources.yolo_labels(spark, base)
    every = [found, sources.texts(spark, base, ".txt"), sources.images(spark, base), sources.images_any_case(spark, base), sources.detection_rows(spark, base, {"x": 1})]
    for df in every:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "binaryFile" not in plan and "text [" not in plan and "Relation" in plan and " parquet" in plan
    assert sorted(r["h"] for r in found.collect()) == [i / 1000 for i in range(20)] and {r["subfolder"] for r in found.collect()} == {"labels"}
    assert [r["path"] for r in every[3].collect()] == [f"file:{tmp_path}/t/images/a+b %.PNG"] and every[2].count() == 0


def test_decoded_by_tasks_as_spark_decodes(spark, tmp_path):
    import numpy as np

    from palimpsest.operators.images import png
    from palimpsest.sinks.crops import png_pixels

    for n in (1, 3, 4):
        (tmp_path / f"{n}.png").write_bytes(png(np.arange(n * 35, dtype=np.uint8).reshape(5, 7, n) * 2))
    (tmp_path / "none.png").write_bytes(b"no image")
    rows = lambda df: sorted((r["origin"].split("/")[-1], r["height"], r["width"], r["nChannels"], r["mode"], bytes(r["data"])) for r in df.collect())
    got = rows(sources.decoded_by(spark, str(tmp_path), png_pixels))
    assert len(got) == 3 and got == rows(sources.decoded(spark, str(tmp_path)))
