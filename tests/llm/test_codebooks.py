import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import codebooks
from palimpsest.llm.codebooks import Books, assign, compress, distances, first_scan, grouped, next_scan

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Lloyd with Python integers."""
    sound = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[int(np.floor(scale * float(np.float32(x)))) for x in r[1]] for r in sound]
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in vectors] for p in range(parts)]
    books = [[list(v) for v in cut[p][:entries]] for p in range(parts)]

    def nearest(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p])) for x in cut[p]]

    for _ in range(rounds):
        for p in range(parts):
            found = nearest(p)
            for i in range(len(books[p])):
                own = [x for x, (_, at) in zip(cut[p], found, strict=True) if at == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    final = [nearest(p) for p in range(parts)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    codes = ["".join(f"{final[p][i][1]:02x}" for p in range(parts)) for i in range(len(sound))]
    errors = [sum(final[p][i][0] for p in range(parts)) for i in range(len(sound))]
    by_label = {}
    for r, e in zip(sound, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted((str(r[0]), c, e, by_label[r[2]], sha) for r, c, e in zip(sound, codes, errors, strict=True))


def drawn(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (9, width))
    return [(i, (centres[rng.integers(9)] + rng.normal(0, 0.1, width)).astype(np.float32).tolist(), None if i % 5 == 0 else int(rng.integers(3))) for i in range(n)]


def got(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.mark.parametrize(("n", "entries", "spread"), [(400, 16, 1.0), (300, 32, 0.001), (40, 256, 1.0)])
def test_against_plain_rounds(spark, n, entries, spread):
    """Also with fewer vectors than entries, and with components so small that most distances are equal."""
    rows = drawn(n, 8, n, spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(compress(df, entries=entries)) == brute(rows, entries=entries)


def test_odd_rows(spark):
    rows = drawn(60, 8, 3)
    rows += [rows[4], rows[4], (None, rows[7][1], 1), (70, None, 1), (71, [1.0] * 7 + [None], 1), (72, [float("nan")] * 8, 1), (73, [float("-inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("code", "error", "v", "LABEL", "sums", "salt"):
        df = df.select("*", F.lit("x").alias(name))
    assert got(compress(df, entries=16)) == brute(rows, entries=16)
    assert compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert compress(spark.createDataFrame([(1, None, 2)], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        compress(spark.createDataFrame([(1, [1.0] * 7, 2)], SCHEMA))
    with pytest.raises(Exception, match="among those of 8"):
        compress(spark.createDataFrame([(1, [1.0] * 8, 2), (2, [1.0] * 4, 2)], SCHEMA)).count()
    with pytest.raises(Exception, match="31 bits"):
        compress(spark.createDataFrame([(1, [1e30] * 8, 2)], SCHEMA)).count()


def test_many_labels_are_joined_by_shuffle(spark, monkeypatch):
    rows = drawn(200, 8, 8)
    monkeypatch.setattr(codebooks, "MOST_LABELS", 2)
    assert got(compress(spark.createDataFrame(rows, SCHEMA), entries=16)) == brute(rows, entries=16)


@pytest.mark.parametrize("scale", [3, 1000, 3_000_000])
def test_bounds_change_no_answer(scale):
    """Round after round the bounded scan gives what a scan of all entries gives, bounds hold, and it looks at less."""
    rng = np.random.default_rng(scale)
    x = np.floor(rng.normal(0, 1, (3_000, 6)) * scale + rng.integers(0, 8, (3_000, 1)) * 6 * scale).astype(np.int64)
    books = Books(x[:64].copy(), 1, 8)
    codes, lower = None, None
    for turn in range(5):
        book, groups = books.books[0], books.groups[0]
        want, d, _ = first_scan(x, book, groups)
        if turn:
            _, _, _, looked = next_scan(x, book, groups, books.moved[0], codes[:, 0].astype(np.int64), lower)
            assert looked < 0.7 * x.shape[0] * len(book)
        codes, error, lower = assign(books, x, codes, lower)
        assert (codes[:, 0] == want).all() and (error == d.astype(np.int64)).all()
        every = np.sqrt(distances(x, book).astype(float))
        every[np.arange(len(x)), want] = np.inf
        for g, members in enumerate(groups):
            assert (lower[:, g] <= every[:, members].min(axis=1)).all()
        counts = np.bincount(want, minlength=64)
        sums = np.zeros((64, 6), np.int64)
        np.add.at(sums, want, x)
        books.update(counts[None], sums[None])


def test_distances_are_exact():
    big = np.array([[2**29, -(2**29)], [2**29 - 1, 5]], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, e, strict=True)) for e in big] for x in big]
    assert distances(big, big).tolist() == want
    with pytest.raises(ValueError, match="64 bits"):
        distances(np.full((1, 8), 2**31 - 1), np.full((1, 8), -(2**31)))


def test_groups_hold_every_entry_once():
    book = np.random.default_rng(1).integers(-50, 50, (100, 4))
    assert sorted(np.concatenate(grouped(book, 16)).tolist()) == list(range(100))
    assert [g.tolist() for g in grouped(book[:1], 16)] == [[0]]
    assert sorted(np.concatenate(grouped(np.zeros((9, 4)), 4)).tolist()) == list(range(9))
