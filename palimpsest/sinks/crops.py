"""Crops of images' pixels: boxes go to the images, whose bytes never leave the task that reads them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.images import png
from palimpsest.operators.layout import suppress
from palimpsest.session import importable
from palimpsest.sinks.tree import at, write_tree
from palimpsest.sources.listing import listed, placed

#: boxes of an image that are cut from it once it is decoded; an image with more is decoded again
BOXES_A_READ = 4_096


def png_pixels(raw: bytes) -> np.ndarray:
    """Pixels (grey, BGR or BGRA) of a PNG file of 8 bits a channel that isn't interlaced."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    where, data, head = 8, [], b""
    while where < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, where)
        body = raw[where + 8 : where + 8 + size]
        head = body if kind == b"IHDR" else head
        data += [body] if kind == b"IDAT" else []
        where += 12 + size
    columns, rows, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced or colour not in (0, 2, 6):
        raise ValueError(f"a PNG file of {depth} bits and colour type {colour}")
    n = {0: 1, 2: 3, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, 1 + columns * n)
    out, above = np.zeros((rows, columns, n), np.uint8), np.zeros((columns, n), np.int64)
    for y, line in enumerate(lines):
        kind, values = int(line[0]), line[1:].reshape(columns, n).astype(np.int64)
        if kind == 1:
            values = np.cumsum(values, axis=0)
        elif kind == 2:
            values = values + above
        elif kind in (3, 4):
            left = np.zeros(n, np.int64)
            corner = np.zeros(n, np.int64)
            for x in range(columns):
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                values[x] = left = (values[x] + guess) & 255
                corner = above[x]
        above = values & 255
        out[y] = above
    return out if n == 1 else out[:, :, [2, 1, 0, 3][:n]]


def numbered(boxes: DataFrame) -> DataFrame:
    """Boxes with ``idx``, their number in the image by ``seq``; dropped boxes are counted too, so kept ones leave gaps."""
    return boxes.withColumn("idx", F.row_number().over(Window.partitionBy("image").orderBy("seq")) - 1)


def write_crops(images: str, boxes: DataFrame, out: str, threshold: float = 0.5, decode: Callable[[bytes], np.ndarray] = png_pixels) -> DataFrame:
    """Cuts ``boxes(image, seq, label, x, y, w, h)`` that ``suppress`` keeps from the images below ``images`` (``image`` is a
    stem) and writes them as ``<image>/<label>/<idx>.png`` below ``out``; gives ``path, written``.

    Boxes are cut off at the border; one that lies outside, or whose image isn't there, gives no file. Paths meet boxes, and a
    task reads and decodes an image where it needs it: pixels aren't shuffled until they are crops, and then not either.
    """
    spark = boxes.sparkSession
    importable(spark)
    kept = numbered(boxes).join(suppress(boxes, threshold).select("image", "seq"), ["image", "seq"], "left_semi")
    box = F.struct("idx", "label", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h")])
    rows = kept.withColumn("part", F.floor(F.col("idx") / BOXES_A_READ)).groupBy("image", "part").agg(F.collect_list(box).alias("boxes"))
    files = placed(listed(spark, images, "*.png"), images).select(F.col("stem").alias("image"), "path")
    work = files.join(rows, "image").select("path", "image", "boxes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = at(images)[0]
        for batch in batches:
            for path, image, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(path) as f:
                    pixels = decode(f.read())
                crops = []
                for b in own:
                    cut = pixels[max(0, b["y"]) : max(0, b["y"] + b["h"]), max(0, b["x"]) : max(0, b["x"] + b["w"])]
                    if cut.size:
                        crops.append((f"{image}/{b['label']}", f"{b['idx']:03}.png", png(np.ascontiguousarray(cut))))
                columns = list(zip(*crops, strict=True)) or [[]] * 3
                yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], names=["folder", "name", "content"])

    return write_tree(work.mapInArrow(run, "folder string, name string, content binary"), out)
