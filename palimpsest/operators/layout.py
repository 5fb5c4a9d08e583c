"""Region detections: suppression, matching, precision and recall, label rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from palimpsest.functions.constants import REGIONS
from palimpsest.functions.geometry import corner_box, iou_xywh, iou_xyxy, normalized_centre
from palimpsest.operators.grid import CROWDED, most_touching, suppressed
from palimpsest.session import stash

#: pairs of an image and class beyond which only boxes that touch are compared
MOST_PAIRS = 250_000


def region_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REGIONS)), "class_id int, label string")


def predictions(detections: DataFrame, classes: DataFrame) -> DataFrame:
    """Detections as whole-pixel boxes with class names; unknown classes go. ``classes`` is a small fixed table."""
    box = corner_box(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    return detections.join(F.broadcast(classes), "class_id").select("image", "seq", "class_id", "label", F.round("confidence", 4).alias("confidence"), *box)


BOX = "struct<seq:{},x:double,y:double,w:double,h:double>"


def seq_type(boxes: DataFrame) -> str:
    """Decimals stay, other numbers are longs."""
    kind = boxes.schema["seq"].dataType
    return kind.simpleString() if isinstance(kind, DecimalType) else "bigint"


def suppress(boxes: DataFrame, threshold: float = 0.5, crowded: int = CROWDED) -> DataFrame:
    """Boxes ``image, seq, x, y, w, h`` that overlap no kept earlier box of the image by more than ``threshold``.

    A fold over the boxes of an image in order of ``seq`` where there are at most ``crowded``; images with more are worked
    on cell by cell, by many tasks. Boxes without an image are one more image, folded.
    """
    many = stash(boxes.groupBy("image").count().filter((F.col("count") > crowded) & F.col("image").isNotNull()).select("image"), "crowded")
    if threshold < 0 or many.isEmpty():
        return folded(boxes, threshold)
    many = small_side(many)
    dense = boxes.join(many, "image", "left_semi").withColumn("seq", F.col("seq").cast(seq_type(boxes)))
    return folded(boxes.join(many, "image", "left_anti"), threshold).unionByName(suppressed(dense, threshold))


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table, to be broadcast where it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def folded(boxes: DataFrame, threshold: float) -> DataFrame:
    row = F.struct(F.col("seq").cast(seq_type(boxes)).alias("seq"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")])
    listed = boxes.groupBy("image").agg(F.sort_array(F.collect_list(row)).alias("boxes"))
    none = F.array().cast(f"array<{BOX.format(seq_type(boxes))}>")
    kept = F.aggregate("boxes", none, lambda acc, b: F.when(F.exists(acc, lambda k: iou_xywh(k, b) > threshold), acc).otherwise(F.concat(acc, F.array(b))))
    return listed.select("image", F.explode(kept).alias("b")).select("image", "b.*")


def corners_of(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Column:
    d = lambda c: F.col(c).cast("double")
    return F.struct(d(x).alias("x1"), d(y).alias("y1"), (d(x) + d(w)).alias("x2"), (d(y) + d(h)).alias("y2"))


def box_pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``image, cls, pid, conf, gid, iou`` of all pairs in an image and class, or null for a prediction that has none."""
    a = found.select("image", "cls", F.col("bid").alias("pid"), "conf", corners_of().alias("p"))
    b = truth.select("image", "cls", F.col("bid").alias("gid"), corners_of().alias("g"))
    both = a.join(b, ["image", "cls"], "left").withColumn("iou", F.when(F.col("gid").isNotNull(), iou_xyxy(F.col("p"), F.col("g"))))
    return both.select("image", "cls", "pid", "conf", "gid", "iou")


def touching_pairs(truth: DataFrame, found: DataFrame, groups: DataFrame) -> DataFrame:
    """The same for the pairs that overlap most, and for each prediction one that doesn't: the truth box ``least`` of its group."""
    box = ("x", "y", "w", "h")
    pairs = most_touching(truth.select("image", "cls", F.col("bid").alias("gid"), *box), found.select("image", "cls", F.col("bid").alias("pid"), "conf", *box), ["image", "cls"])
    apart = found.join(groups, ["image", "cls"]).select("image", "cls", F.col("bid").alias("pid"), "conf", F.col("least").alias("gid"), F.lit(0.0).alias("iou"))
    return pairs.unionByName(apart)


def best_matches(truth: DataFrame, found: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """For each prediction ``image, cls, pid`` the truth box it overlaps most: ``best`` (smallest id of equals) and ``iou``.

    Boxes of an image and class are all compared where that makes at most ``most_pairs`` pairs; in others, those that touch.
    """
    there = truth.groupBy("image", "cls").agg(F.count("*").alias("n"), F.min("bid").alias("least"))
    pairs = there.join(found.groupBy("image", "cls").agg(F.count("*").alias("m")), ["image", "cls"])
    groups = stash(pairs.filter(F.col("n").cast("double") * F.col("m") > most_pairs).select("image", "cls", "least"), "crowded")
    if groups.isEmpty():
        both = box_pairs(truth, found)
    else:
        groups = small_side(groups)
        of, but = ((lambda df, how=how: df.join(groups.drop("least"), ["image", "cls"], how)) for how in ("left_semi", "left_anti"))
        both = box_pairs(but(truth), but(found)).unionByName(touching_pairs(of(truth), of(found), groups))
    best = F.max(F.when(F.col("gid").isNotNull(), F.struct(F.col("iou"), (-F.col("gid")).alias("minus"))))
    out = both.groupBy("image", "cls", "pid").agg(F.first("conf").alias("conf"), best.alias("best"))
    return out.select("image", "cls", "pid", "conf", (-F.col("best.minus")).alias("gid"), F.col("best.iou").alias("iou"))


def match_counts(truth: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``cls, tp, fp, fn``: of predictions on one truth box one counts, so what is matched are different truth boxes."""
    best = best_matches(truth, found)
    hits = best.groupBy("image", "cls").agg(F.count("*").alias("n_pred"), F.count_distinct(F.when(F.col("iou") >= threshold, F.col("gid"))).alias("tp"))
    there = truth.groupBy("image", "cls").agg(F.count("*").alias("n_true"))
    every = there.join(hits, ["image", "cls"], "full_outer").fillna(0, ["n_pred", "tp", "n_true"])
    return every.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum(F.col("n_pred") - F.col("tp")).alias("fp"), F.sum(F.col("n_true") - F.col("tp")).alias("fn"))


def labelled_matches(truth: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each prediction with ``is_tp``: the first claimant of its best truth box, by confidence, then id.

    The first is an aggregate and comes back by the prediction's own name, so a truth box that many claim is no one's task.
    """
    best = stash(best_matches(truth, found), "matches")
    order = F.struct(F.col("conf").isNull(), -F.col("conf"), F.col("pid"))
    claims = best.filter(F.col("iou") >= threshold).groupBy("image", "cls", "gid").agg(F.min_by("pid", order).alias("pid"))
    claims = claims.select("image", "cls", "pid", F.lit(1).alias("is_tp"))
    return best.join(claims, ["image", "cls", "pid"], "left").select("image", "cls", "pid", F.coalesce("is_tp", F.lit(0)).alias("is_tp"))


def rates(counts: DataFrame) -> DataFrame:
    """``cls, tp, fp, fn, precision, recall, f1`` by class and over all (null class, ``is_total`` 1); 0 where there is nothing."""
    sums = counts.rollup("cls").agg(F.grouping("cls").cast("int").alias("is_total"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def label_rows(boxes: DataFrame) -> DataFrame:
    """``image, seq, line``: label rows with normalised centres, six decimals."""
    centre = normalized_centre(*[F.col(c).cast("double") for c in ("x", "y", "w", "h", "image_width", "image_height")])
    rows = boxes.select("image", "seq", "cls", *centre)
    return rows.select("image", "seq", F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h").alias("line"))


def label_files(rows: DataFrame) -> DataFrame:
    """One text for each image, rows in order."""
    return rows.groupBy("image").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]), "\n").alias("content"))


def dataset_splits(counts: DataFrame) -> DataFrame:
    """Which split serves as train, val and test: the first with images of dev, test; of test, dev; else what comes before."""
    n = lambda s: F.coalesce(F.max(F.when(F.col("split") == s, F.col("n"))), F.lit(0))
    one = counts.agg(n("dev").alias("dev"), n("test").alias("test"))
    val = F.when(F.col("dev") > 0, F.lit("dev")).when(F.col("test") > 0, F.lit("test")).otherwise(F.lit("train"))
    test = F.when(F.col("test") > 0, F.lit("test")).when(F.col("dev") > 0, F.lit("dev")).otherwise(val)
    return one.select(F.lit("train").alias("train"), val.alias("val"), test.alias("test"))


def prefilled(boxes: DataFrame, classes: DataFrame, least: int = 15) -> DataFrame:
    """Boxes of known classes that are at least ``least`` pixels wide and high."""
    return boxes.join(F.broadcast(classes.select(F.col("class_id").alias("cls"), "label")), "cls").filter((F.col("w") >= least) & (F.col("h") >= least))


def crop_metadata(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``image, metadata``: for each class the kept crops with their names; the index counts dropped boxes too."""
    order = Window.partitionBy("image").orderBy("seq")
    indexed = boxes.withColumn("idx", F.row_number().over(order) - 1)
    kept = suppress(boxes, threshold).select("image", "seq")
    rows = indexed.join(kept, ["image", "seq"])
    crop = F.struct(F.concat(F.lpad(F.col("idx").cast("string"), 3, "0"), F.lit(".jpg")).alias("cropped_image_name"), F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height")).alias("coordinates"))
    by_class = rows.groupBy("image", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", crop.alias("crop")))), lambda r: r["crop"]).alias("crops"))
    return by_class.groupBy("image").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "crops")))).alias("metadata"))
