import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import grid
from palimpsest.operators.layout import best_matches, box_pairs, folded, labelled_matches, match_counts, suppress
from palimpsest.plans import crowded
from palimpsest.plans.registry import QUERIES

BOX = "image string, seq long, x double, y double, w double, h double"


def scattered(rng, n, extent, least=5.0, most=400.0):
    """Boxes of many sizes, a third of them near copies of one before."""
    size = np.exp(rng.uniform(np.log(least), np.log(most), (n, 2)))
    at = rng.uniform(-extent / 2, extent / 2, (n, 2))
    for i in range(2, n, 3):
        j = int(rng.integers(0, i))
        at[i], size[i] = at[j] + rng.normal(0, size[j] * 0.1), size[j] * rng.uniform(0.8, 1.25, 2)
    return np.concatenate([at, size], axis=1)


def fold(boxes, threshold):
    """Plain greedy suppression; indexes of what is kept."""
    kept = []
    for i, (x, y, w, h) in enumerate(boxes):
        k = boxes[kept]
        shared = np.clip(np.minimum(k[:, 0] + k[:, 2], x + w) - np.maximum(k[:, 0], x), 0, None) * np.clip(np.minimum(k[:, 1] + k[:, 3], y + h) - np.maximum(k[:, 1], y), 0, None)
        union = k[:, 2] * k[:, 3] + w * h - shared
        if not (np.divide(shared, union, out=np.zeros_like(shared), where=union > 0) > threshold).any():
            kept.append(i)
    return kept


def frame(spark, boxes, image="a"):
    return spark.createDataFrame([(image, i, *map(float, b)) for i, b in enumerate(boxes)], BOX)


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


SCENES = {
    "scattered": lambda rng: scattered(rng, 2_000, 3_000),
    "a heap": lambda rng: np.concatenate([rng.normal(0, 15, (1_500, 2)), rng.uniform(80, 120, (1_500, 2))], axis=1),
    "a chain": lambda rng: np.stack([np.arange(700) * 10.0, np.zeros(700), np.full(700, 32.0), np.full(700, 32.0)], axis=1),
    "borders": lambda rng: np.concatenate([rng.integers(-4, 5, (600, 2)) * 16.0, 2.0 ** rng.integers(2, 7, (600, 2))], axis=1),
}


@pytest.mark.parametrize(("name", "threshold"), [*((name, 0.5) for name in SCENES), ("borders", 0.17)])
def test_crowded_suppression_equals_the_fold(spark, name, threshold):
    boxes = SCENES[name](np.random.default_rng(3))
    assert seqs(grid.suppressed(frame(spark, boxes), threshold)) == fold(boxes, threshold)


def test_the_table_by_the_fold(spark, sf_dir):
    rows = {}
    for r in crowded.crowded_found(spark, sf_dir).collect():
        rows.setdefault(r["image"], []).append((r["bid"], r["x"], r["y"], r["w"], r["h"]))
    want = []
    for image, own in rows.items():
        own.sort()
        want += [(image, own[i][0]) for i in fold(np.array([b[1:] for b in own], float), 0.5)]
    got = [(r["image"], r["seq"]) for r in QUERIES["j12_crowded_suppression"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and max(map(len, rows.values())) > 1_000


def test_any_overlap_counts_at_threshold_zero(spark):
    boxes = scattered(np.random.default_rng(8), 500, 2_000)
    assert seqs(grid.suppressed(frame(spark, boxes), 0.0)) == fold(boxes, 0.0)


def test_rounds_and_thinning_are_run(spark, monkeypatch):
    """With few pairs left to one task others are decided in rounds; with few pairs a box, a heap is thinned first."""
    boxes = scattered(np.random.default_rng(5), 150, 500)
    left, thinned = [], []
    finish, thin = grid.finish, grid.thinned
    monkeypatch.setattr(grid, "finish", lambda e: left.append(e.count()) or finish(e))
    monkeypatch.setattr(grid, "thinned", lambda b, t: thinned.append(1) or thin(b, t))
    made = grid.conflicts(grid.sized(frame(spark, boxes)).withColumn("row", F.monotonically_increasing_id()), 0.5).count()
    assert seqs(grid.suppressed(frame(spark, boxes), 0.5, left=made // 4)) == fold(boxes, 0.5)
    assert 0 < left[0] <= made // 4 and not thinned
    monkeypatch.setattr(grid, "PAIRS_A_BOX", 30)
    heap = SCENES["a heap"](np.random.default_rng(1))[:200]
    assert seqs(grid.suppressed(frame(spark, heap), 0.5)) == fold(heap, 0.5)
    assert thinned


def test_a_heap_makes_no_pairs_of_all(spark):
    """3000 boxes on one spot have 4.5 million pairs; thinning leaves a few for each box."""
    boxes = SCENES["a heap"](np.random.default_rng(1))
    boxes = np.concatenate([boxes] * 2)
    df = grid.sized(frame(spark, boxes)).withColumn("row", F.monotonically_increasing_id())
    assert grid.possible_pairs(df) > 300 * len(boxes)
    kept, left = grid.thinned(df, 0.5)
    assert kept.count() >= 1 and left.count() < len(boxes) / 2
    assert seqs(suppress(frame(spark, boxes), 0.5)) == fold(boxes, 0.5)


def test_crowded_and_other_images_together(spark):
    rng = np.random.default_rng(4)
    one, two = scattered(rng, 300, 500), scattered(rng, 40, 200)
    df = frame(spark, one, "a").unionByName(frame(spark, two, "b")).unionByName(frame(spark, two, None))
    df = df.unionByName(spark.createDataFrame([("a", 900, None, 1.0, 2.0, 2.0), ("a", 901, 5.0, 5.0, 0.0, 9.0), ("a", 902, 5.0, 5.0, 0.0, 9.0)], BOX))
    got = sorted((str(r["image"]), r["seq"]) for r in suppress(df, 0.5, crowded=100).collect())
    assert got == sorted((str(r["image"]), r["seq"]) for r in folded(df, 0.5).collect())
    assert {s for i, s in got if i == "a"} == {*fold(one, 0.5), 900, 901, 902}
    empty = spark.createDataFrame([], BOX)
    assert suppress(empty).count() == 0 and grid.suppressed(empty, 0.5).count() == 0


def test_equal_rows_come_one_after_the_other(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0, 9.0, 9.0)] * 3 + [("a", 1, 50.0, 0.0, 9.0, 9.0)], BOX)
    assert grid.suppressed(df, 0.5).count() == folded(df, 0.5).count() == 2


def matches(df, *columns):
    return sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_touching_pairs_give_the_same_matches(spark, seed):
    rng = np.random.default_rng(seed)
    schema = "image string, bid long, cls long, x long, y long, w long, h long"
    rows = [("a" if i % 4 else "b", i, int(i % 2), *map(int, b)) for i, b in enumerate(scattered(rng, 900, 2_000, 2, 900))]
    truth = spark.createDataFrame(rows[:500] + [("only truth", 1, 0, 0, 0, 9, 9)], schema)
    found = spark.createDataFrame([(*r, float(i % 7)) for i, r in enumerate(rows[300:])] + [("only found", 1, 0, 0, 0, 9, 9, 0.5), ("a", 5_000, 1, 10**6, 10**6, 9, 9, 0.5)], schema + ", conf double")
    columns = ("image", "cls", "pid", "conf", "gid", "iou")
    few, all_pairs = best_matches(truth, found, most_pairs=100), best_matches(truth, found, most_pairs=10**9)
    assert matches(few, *columns) == matches(all_pairs, *columns)
    assert box_pairs(truth, found).count() > 30_000


def test_matches_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr("palimpsest.operators.layout.MOST_PAIRS", 1)
    truth = [("a", 1, 0, 0, 0, 10, 10), ("a", 2, 0, 100, 0, 10, 10)]
    found = [("a", 7, 0, 1, 0, 10, 10, 0.5), ("a", 8, 0, 0, 1, 10, 10, 0.9), ("a", 9, 0, 500, 0, 10, 10, 0.99)]
    schema = "image string, bid long, cls long, x long, y long, w long, h long"
    t, f = spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema + ", conf double")
    assert matches(labelled_matches(t, f), "pid", "is_tp") == [(7, 0), (8, 1), (9, 0)]
    assert matches(match_counts(t, f), "cls", "tp", "fp", "fn") == [(0, 1, 2, 1)]
