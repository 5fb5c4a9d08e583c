"""Column expressions over boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.greatest(F.least(a_high, b_high) - F.greatest(a_low, b_low), F.lit(0.0))


def iou_xywh(a: Column, b: Column) -> Column:
    """Of structs x, y, w, h: 0 where the union is empty."""
    shared = overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def iou_xyxy(a: Column, b: Column) -> Column:
    """Of structs x1, y1, x2, y2: the union counts as at least 1e-6."""
    shared = overlap(a["x1"], a["x2"], b["x1"], b["x2"]) * overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    return shared / F.greatest(area(a) + area(b) - shared, F.lit(1e-6))


def corner_box(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    """Centre to corner, cut to whole pixels toward 0."""
    return [(cx - w / 2).cast("int").alias("x"), (cy - h / 2).cast("int").alias("y"), w.cast("int").alias("width"), h.cast("int").alias("height")]


def clamped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def normalized_centre(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    return [clamped((x + w / 2) / width).alias("cx"), clamped((y + h / 2) / height).alias("cy"), clamped(w / width).alias("w"), clamped(h / height).alias("h")]


def corners(cx: Column, cy: Column, w: Column, h: Column, width: Column | float = 1.0, height: Column | float = 1.0) -> list[Column]:
    width, height = (F.lit(v) if isinstance(v, float) else v for v in (width, height))
    return [((cx - w / 2) * width).alias("x1"), ((cy - h / 2) * height).alias("y1"), ((cx + w / 2) * width).alias("x2"), ((cy + h / 2) * height).alias("y2")]


def same_padding(size: Column, kernel: int = 3, stride: int = 1, dilation: int = 1) -> list[Column]:
    """Padding before and after one dimension so that ``ceil(size / stride)`` places come out; halves round down before."""
    outputs = F.ceil(size / F.lit(stride)).cast("long")
    whole = ((outputs - 1) * stride + kernel - size) * dilation
    before = F.floor(whole / 2).cast("long")
    return [before.alias("pad_before"), (whole - before).cast("long").alias("pad_after")]


def palette(n: int) -> list[str]:
    """``n`` colours at equal steps of hue."""
    import colorsys

    return ["#" + "".join(f"{int(c * 255):02x}" for c in colorsys.hsv_to_rgb(i / n, 0.75, 0.95)) for i in range(n)]
