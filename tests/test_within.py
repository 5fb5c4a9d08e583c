"""Texts that hold the other, and bands: the same distances and steps as without."""

import random

import numpy as np

from palimpsest.functions import edit


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def spoilt(rng, n):
    a = "".join(rng.choice("abcde é") for _ in range(n))
    kinds = [a.translate(str.maketrans("ae", "ea")), a.replace(" ", ""), "".join(c for c in a if rng.random() < 0.9), "".join(c if rng.random() < 0.9 else rng.choice(["", "x", "ab"]) for c in a)]
    return [(a, b) for b in kinds] + [(b, a) for b in kinds]


def test_distances_and_steps(monkeypatch):
    rng = random.Random(4)
    pairs = [p for n in (3, 17, 80, 300) for p in spoilt(rng, n)]
    assert edit.distances(*map(list, zip(*pairs, strict=True))) == [table(a, b) for a, b in pairs] == [edit.distance(a, b) for a, b in pairs]
    for a, b in pairs:
        x, y = edit.codes(a, b)
        assert bytes(edit._steps(x, y)) == bytes(edit._back(x, y))


def test_bands():
    rng = random.Random(9)
    for n in (70, 200, 700):
        for a, b in spoilt(rng, n):
            x, y = edit.codes(*sorted((a, b), key=len, reverse=True))
            assert edit._by_vectors(x, y) == table(a, b)


def test_texts_that_hold_the_other_take_no_table(monkeypatch):
    def no(*_):
        raise AssertionError("a table was made")

    for name in ("_by_vectors", "_back", "reached"):
        monkeypatch.setattr(edit, name, no)
    monkeypatch.setattr(edit.side_by_side, "_in_step", no)
    text = " ".join(map(str, range(5_000)))
    bare = text.replace(" ", "")
    assert edit.distances([text, bare], [bare, text]) == [4_999, 4_999] and edit.distance(text, bare) == 4_999
    assert len(edit.align(text, bare)) == 2 * 4_999 + 1


def test_bands_take_fewer_rows(monkeypatch):
    rows = []
    places = edit.Places
    monkeypatch.setattr(edit, "Places", lambda a: rows.append(len(a)) or places(a))
    x = np.random.default_rng(1).integers(0, 40, 4_000).astype(np.uint32)
    y = np.where(np.arange(4_000) % 5 == 0, x + 50, x).astype(np.uint32)
    assert edit._by_vectors(x, y) == 800
    assert np.mean(rows) < 0.35 * 4_000
