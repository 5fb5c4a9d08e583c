import random
import time

import numpy as np
import pytest

from palimpsest.functions import edit


def spoilt(text, edits, rng, letters="abcde "):
    out = list(text)
    for _ in range(edits):
        at, how = rng.randrange(len(out) + 1), rng.randrange(3)
        if how == 0:
            out.insert(at, rng.choice(letters))
        elif out and how == 1:
            del out[min(at, len(out) - 1)]
        elif out:
            out[min(at, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


def full(a, b):
    """Distances of all prefixes."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
    return d


@pytest.mark.parametrize("seed", range(60))
def test_both_ways_give_the_same_path(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefgh "
    text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 30, 200])))
    other = spoilt(text, rng.choice([0, 1, 5, 40]), rng, letters) if seed % 3 else "".join(rng.choice(letters) for _ in range(rng.choice([0, 2, 50])))
    a, b = edit.codes(text, other)
    want = full(text, other)
    near = edit.reached(a, b, len(a) + len(b), True)
    assert near[0] == want[-1, -1] == edit._by_vectors(a, b) if len(b) else near[0] == len(a)
    for e, row in enumerate(near[1]):
        for k in range(-e, e + 1):
            on = [i for i in range(len(a) + 1) if 0 <= i - k <= len(b) and want[i, i - k] <= e]
            assert (max(on) if on else edit.NOWHERE) == row[k + e]
    if len(a) and len(b):
        assert edit._back_by_diagonals(a, b, *near).tobytes() == bytes(edit._back(a, b))
    if near[0]:
        assert edit.reached(a, b, near[0] - 1, True) is None


def test_a_million_characters_with_a_hundred_edits():
    rng = random.Random(1)
    text = "".join(rng.choice("etaoin shrdlu") for _ in range(1_000_000))
    other = spoilt(text, 100, rng)
    began = time.thread_time()
    chunks = edit.align(text, other)
    took = time.thread_time() - began
    edits = sum(max(re - rs, he - hs) for op, rs, re, hs, he in chunks.tolist() if op != edit.EQUAL)
    assert edits == edit.distance(text, other) <= 100
    assert took < 4  # 0.3 s on a free core
    rebuilt = "".join(text[rs:re] if op == edit.EQUAL else other[hs:he] for op, rs, re, hs, he in chunks.tolist())
    assert rebuilt == other


def test_repeated_text_and_lists():
    assert edit.distance("ab" * 50_000, "ab" * 50_000 + "a") == 1
    assert edit.distance("a" * 30_000, "a" * 29_990) == 10
    words = [f"w{i % 7}" for i in range(5_000)]
    assert edit.distance(words, words[:100] + ["x"] + words[101:]) == 1
    assert edit.distance("x" * 3_000, "y" * 3_000) == 3_000
