"""Sources that are trees of files: images, texts, annotations, manifests.

Trees with a file for each row are listed and read by tasks (``listing``): Spark's own sources hold every file's status on the
driver, and give each small file the weight of megabytes. Those remain for stores that pyarrow doesn't reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import strip
from palimpsest.operators.images import MODES, SCHEMA
from palimpsest.session import importable
from palimpsest.sources import listing
from palimpsest.sources.labels import parse_label_line, parse_named_line

IMAGES = "*.{jpg,jpeg,png}"
BOX = "array<struct<class_id:int,label:string,x:double,y:double,width:double,height:double>>"
ANNOTATION = f"filename string, subfolder string, text string, split string, image_width double, image_height double, boxes {BOX}"


def relative(path: Column, base: str) -> Column:
    """A file's path below ``base``, whatever scheme either has."""
    root = base.split("://")[-1].split(":", 1)[-1].strip("/")
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), rf"^.*?\Q{root}\E/", "")


def place(df: DataFrame, base: str, path: str = "path") -> DataFrame:
    """Adds ``subfolder`` and ``stem`` of files below ``base``."""
    df = df.withColumn("rel", relative(F.col(path), base))
    return df.withColumn("subfolder", F.regexp_extract("rel", r"^(.*)/[^/]*$", 1)).withColumn("stem", F.regexp_replace(F.regexp_extract("rel", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def images(spark: SparkSession, base: str, pattern: str = IMAGES, recursive: bool = True, limit: int | None = None) -> DataFrame:
    """``path, modificationTime, length`` in order of path; the contents aren't read. A limit of 0 is none."""
    found = files_below(spark, base, pattern, recursive).orderBy("path")
    return found.limit(limit) if limit else found


def files_below(spark: SparkSession, base: str, pattern: str = "*", recursive: bool = True, any_case: bool = False) -> DataFrame:
    """``path, modificationTime, length`` in no order."""
    if listing.reachable(base):
        return listing.spelt(listing.listed(spark, base, pattern, recursive, any_case), base).select("path", "modificationTime", "length")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = (reader if any_case else reader.option("pathGlobFilter", pattern)).load(base).select("path", "modificationTime", "length")
    return found.filter(listing.named(F.regexp_extract("path", r"([^/]*)$", 1), pattern, True)) if any_case else found


def whole(spark: SparkSession, base: str, pattern: str) -> DataFrame:
    """``subfolder, stem, value``: the whole text of every file whose name matches."""
    if listing.reachable(base):
        files = listing.contents(listing.listed(spark, base, pattern), base)
        return listing.placed(files, base).select("subfolder", "stem", F.col("content").cast("string").alias("value"))
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(base, wholetext=True)
    return place(raw.withColumn("path", F.col("_metadata.file_path")), base).select("subfolder", "stem", "value")


def images_any_case(spark: SparkSession, base: str) -> DataFrame:
    """As ``images``, with extensions in any case and no order."""
    return files_below(spark, base, "*.{png,jpg,jpeg}", any_case=True)


def line_images(spark: SparkSession, base: str) -> DataFrame:
    """Images in folders called ``lines``."""
    return images_any_case(spark, base).filter(F.col("path").rlike("/lines/[^/]+$"))


def texts(spark: SparkSession, base: str, extension: str, column: str = "text") -> DataFrame:
    """``subfolder, stem`` and the stripped text of every file with an extension that has bytes: one without holds no text, and
    Spark's text source doesn't give it either."""
    if listing.reachable(base):
        return listing.texts(spark, base, extension, column)
    return whole(spark, base, f"*{extension}").select("subfolder", "stem", strip(F.col("value")).alias(column))


def pair_trees(spark: SparkSession, predictions: str, labels: str, prediction_ext: str = ".md", label_ext: str = ".txt") -> tuple[DataFrame, DataFrame]:
    """Two trees as the tables that ``scoring.collect_pairs`` joins."""
    return texts(spark, predictions, prediction_ext, "prediction"), texts(spark, labels, label_ext, "reference")


def split_annotations(spark: SparkSession, base: str) -> DataFrame:
    """``<base>/<split>/annotations.json`` of all splits, with ``split`` from the folder."""
    raw = spark.read.schema(ANNOTATION).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "annotations.json").json(base)
    return raw.withColumn("split", F.regexp_extract(relative(F.col("_metadata.file_path"), base), r"^([^/]+)/", 1))


def images_and_labels(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """``path, modificationTime, length`` of the images below ``base``, and ``subfolder, stem`` of its label files: with ``path,
    length`` from one listing for ``listing.with_texts``, or with ``text`` where tasks can't read the store."""
    if not listing.reachable(base):
        return files_below(spark, base, IMAGES), texts(spark, base, ".txt")
    found = listing.listed(spark, base)
    of = lambda pattern: found.filter(listing.named(F.col("name"), pattern))
    return listing.spelt(of(IMAGES), base).select("path", "modificationTime", "length"), listing.placed(of("*.txt"), base)


def with_labels(spark: SparkSession, base: str, found: DataFrame, labels: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``found`` with the ``text`` of its label."""
    if "text" in labels.columns:
        return found.join(labels.hint("merge"), keys, how)
    return listing.with_texts(found, labels, keys, base, how)


def split_crops(spark: SparkSession, base: str) -> DataFrame:
    """``split, subfolder, stem, filename, path, text`` of all crops on disk: ``<split>/images/...`` with labels beside them."""
    found, labels = images_and_labels(spark, base)
    found = found.withColumn("rel", relative(F.col("path"), base)).filter("rel rlike '^[^/]+/images/'")
    found = found.select(
        F.regexp_extract("rel", r"^([^/]+)/", 1).alias("split"), F.regexp_extract("rel", r"^[^/]+/images/(?:(.*)/)?[^/]*$", 1).alias("subfolder"), F.regexp_extract("rel", r"([^/]*)$", 1).alias("filename"), "path"
    ).withColumn("stem", F.regexp_replace("filename", r"\.[^.]*$", ""))
    labels = labels.filter("subfolder rlike '^[^/]+/labels(/|$)'").select(
        F.regexp_extract("subfolder", "^([^/]+)/", 1).alias("split"), F.regexp_extract("subfolder", "^[^/]+/labels/?(.*)$", 1).alias("subfolder"), *[c for c in ("stem", "text", "path", "length") if c in labels.columns]
    )
    return with_labels(spark, base, found, labels, ["split", "subfolder", "stem"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """JSON lines ``image, region, text`` with the image's whole path; blank lines are skipped."""
    return spark.read.schema("image string, region string, text string").json(path).filter("image is not null").withColumn("image_path", F.concat_ws("/", F.lit(root.rstrip("/")), "image"))


def yolo_labels(spark: SparkSession, base: str) -> DataFrame:
    """``stem, cls, cx, cy, w, h`` of label files."""
    lines = whole(spark, base, "*.txt").select("subfolder", "stem", F.explode(F.split("value", r"\r\n|[\r\n]")).alias("value"))
    return lines.select("subfolder", "stem", F.explode(F.array(parse_label_line(F.col("value")))).alias("p")).filter("p is not null").select("subfolder", "stem", "p.*")


def detection_rows(spark: SparkSession, base: str, classes: dict[str, int]) -> DataFrame:
    """``file_name, objects(bbox, categories)`` of label files whose class is an id or a name."""
    ids = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    lines = whole(spark, base, "*.txt").withColumn("lines", F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))
    parsed = F.filter(F.transform("lines", lambda x: parse_named_line(x, ids)), lambda p: p["class_id"].isNotNull())
    return lines.withColumn("p", parsed).select(F.concat("stem", F.lit(".jpg")).alias("file_name"), F.struct(F.transform("p", lambda x: x["bbox"]).alias("bbox"), F.transform("p", lambda x: x["class_id"]).alias("categories")).alias("objects"))


def image_folder(spark: SparkSession, base: str) -> DataFrame:
    """Images joined with the rows of ``metadata.jsonl``, whose ``file_name`` is relative to the folder that file is in."""
    if listing.reachable(base):
        there = files_below(spark, base, "metadata.jsonl").select("path").collect()  # one for each folder
        if not there:
            raise FileNotFoundError(f"{base}: no metadata.jsonl")
        meta = spark.read.json([r["path"] for r in there])
    else:
        meta = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.jsonl").json(base)
    folder = F.regexp_extract(relative(F.col("_metadata.file_path"), base), r"^(.*/)?[^/]*$", 1)
    meta = meta.withColumn("rel", F.concat(folder, "file_name"))
    return images(spark, base).withColumn("rel", relative(F.col("path"), base)).join(meta, "rel").drop("rel")


def decoded(spark: SparkSession, base: str) -> DataFrame:
    """``origin, height, width, nChannels, mode, data`` of the images below ``base``, decoded by Spark; others are left."""
    return spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(base).select("image.*")


def decoded_by(spark: SparkSession, base: str, decode: Callable[[bytes], np.ndarray], pattern: str = "*") -> DataFrame:
    """As ``decoded``, of files listed and read by tasks and decoded by ``decode``; one that it refuses with a ValueError is left."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                try:
                    pixels = decode(content)
                except ValueError:
                    continue
                rows.append((path, *pixels.shape, MODES[pixels.shape[2]], np.ascontiguousarray(pixels).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.string(), *[pa.int32()] * 4, pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["origin", "height", "width", "nChannels", "mode", "data"])

    files = listing.contents(listing.listed(spark, base, pattern), base)
    return listing.spelt(files.mapInArrow(run, SCHEMA), base, "origin")


def sidecars(found: DataFrame, beside: DataFrame, in_label: DataFrame) -> DataFrame:
    """Each image's text from beside it, else from the sibling ``label`` folder, else empty."""
    a = beside.select("subfolder", "stem", F.col("text").alias("a"))
    b = in_label.select("subfolder", "stem", F.col("text").alias("b"))
    return found.join(a, ["subfolder", "stem"], "left").join(b, ["subfolder", "stem"], "left").withColumn("text", F.coalesce("a", "b", F.lit(""))).drop("a", "b")


def legacy_annotations(spark: SparkSession, base: str) -> DataFrame:
    """Old crops with their labels; those without or with empty ones are left. Splits are given by ``curation.assign_splits``."""
    found, labels = images_and_labels(spark, base)
    found = place(found, base).withColumn("filename", F.regexp_extract("path", "([^/]*)$", 1))
    at = lambda kind: F.regexp_replace("subfolder", rf"(^|/){kind}s?(?=/|$)", "$1label").alias("label_at")
    labels = labels.select(at("label"), *[c for c in ("stem", "text", "path", "length") if c in labels.columns])
    return with_labels(spark, base, found.withColumn("label_at", at("image")), labels, ["label_at", "stem"], "inner").filter("text <> ''").drop("label_at")


def small_text(spark: SparkSession, path: str) -> str:
    """A prompt or schema of one file."""
    rows = spark.read.text(path, wholetext=True).take(1)
    return rows[0]["value"] if rows else ""


def report_stats(spark: SparkSession, path: str) -> DataFrame:
    """``global`` numbers of metrics files."""
    return spark.read.option("multiLine", "true").json(path).select("global.*")


def entity_schema(text: str) -> str:
    """Struct of nullable strings from a JSON schema of a function call."""
    import json

    fields = json.loads(text)["parameters"]["properties"]
    return "struct<" + ",".join(f"`{name}`:string" for name in fields) + ">"
