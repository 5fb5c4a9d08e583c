"""Boxes of tables with far more orders than a long holds numbers for."""

import decimal

from __spark_entry__ import queries
from pyspark.sql import functions as F


def sheet(spark, sf_dir, path, more):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") + F.when(F.col("l_orderkey") % 2 == 0, more).otherwise(0))
    df.write.parquet(f"{path}/lineitem.parquet")
    return queries()["j12_crowded_suppression"](spark, str(path))


def test_suppression_where_numbers_of_boxes_exceed_a_long(spark, sf_dir, tmp_path):
    """Order keys beyond 11 million overflowed; moved keys must give as many boxes as are there by their own order."""
    got = sheet(spark, sf_dir, tmp_path / "far", 40_009 * 2_000)
    assert got.schema["seq"].dataType.simpleString() == "decimal(38,0)"
    rows = sorted(tuple(r) for r in got.collect())
    moved = spark.read.parquet(f"{tmp_path}/far/lineitem.parquet").filter("l_partkey % 11 <> 0").collect()
    ids = {((r["l_orderkey"] * 8 + r["l_linenumber"]) * 1_000_000 + r["l_partkey"]) * 100_000 + r["l_suppkey"] for r in moved}
    kept = [int(r[1]) for r in rows]
    assert set(kept) <= ids and max(kept) > 2**63 and isinstance(rows[0][1], decimal.Decimal)
    assert {tuple(r)[2:] for r in rows} and 0 < len(rows) < len(moved)
    boxes = {}
    for r in moved:
        x = r["l_orderkey"] * 7919 % 40009 + r["l_partkey"] * 37 % 90 + r["l_partkey"] % 7 * 6
        y = r["l_suppkey"] * 5003 % 30011 + r["l_partkey"] * 53 % 120 + r["l_suppkey"] % 5 * 6
        seq = ((r["l_orderkey"] * 8 + r["l_linenumber"]) * 1_000_000 + r["l_partkey"]) * 100_000 + r["l_suppkey"]
        boxes.setdefault(r["l_returnflag"], []).append((seq, x, y, int(40 + 4 * r["l_quantity"]), int(60 + r["l_quantity"])))
    want = []
    for image, every in boxes.items():
        fine = []
        for s, x, y, w, h in sorted(every):
            for _, a, b, c, d in fine:
                shared = max(min(x + w, a + c) - max(x, a), 0) * max(min(y + h, b + d) - max(y, b), 0)
                if shared / (w * h + c * d - shared) > 0.5:
                    break
            else:
                fine.append((s, x, y, w, h))
        want += [(image, *f) for f in fine]
    assert sorted((r[0], int(r[1]), *map(int, r[2:])) for r in rows) == sorted(want)


def test_smaller_tables_keep_their_numbers(spark, sf_dir, tmp_path):
    assert sheet(spark, sf_dir, tmp_path / "near", 0).schema["seq"].dataType.simpleString() == "bigint"


def test_tiles_order_decimals_as_longs(spark):
    import numpy as np

    from palimpsest.operators import grid

    rng = np.random.default_rng(4)
    rows = [("s", int(i), float(x), float(y), 60.0, 40.0) for i, x, y in zip(rng.permutation(900), *rng.integers(0, 900, (2, 900)), strict=True)]
    df = grid.sized(spark.createDataFrame(rows, "image string, seq long, x double, y double, w double, h double")).withColumn("row", F.monotonically_increasing_id())
    kept = lambda d: [sorted(int(r["seq"]) for r in part.collect()) for part in grid.tiled(d, 0.5)]
    assert kept(df) == kept(df.withColumn("seq", F.col("seq").cast("decimal(38,0)"))) and kept(df)[0]
