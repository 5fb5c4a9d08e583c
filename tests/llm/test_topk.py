import math

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import topk
from palimpsest.llm.queries import QUERIES
from palimpsest.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in sound:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in sound if i != q)
            out[q] = [(rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_op1_over_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert result(QUERIES["op1_top_k"](spark, sf_dir)) == brute(rows)


def test_cells_ties_and_sparse_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_A_CELL", 37)
    monkeypatch.setattr(topk, "QUERIES_A_CELL", 5)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) if rng.random() < 0.3 else 0.0 for x in rng.integers(-2, 3, 6) / 64]) for i in rng.permutation(300)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert result(top_k(df, F.col("vec_id") % 10 == 0)) == brute(rows, every=10)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0]), (7, [0.5, -0.25, 3.0]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (8, [1e-9, -1e-9])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).selectExpr("*", "'x' AS score", "'y' AS query_id")
    assert result(top_k(df, F.col("vec_id") % 50 == 0)) == brute(rows)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k(df.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
    twice = spark.createDataFrame([(0, [1.0], 0), (0, [1.0], 0), (3, [2.0], 0), (3, [2.0], 0)], SCHEMA)
    assert result(top_k(twice, F.col("vec_id") % 50 == 0)) == {0: [(1, 3, 131072), (2, 3, 131072)]}
    huge = spark.createDataFrame([(0, [1.0], 0), (3, [1e30], 0)], SCHEMA)
    assert top_k(huge, F.col("vec_id") % 50 == 0).count() == 1
