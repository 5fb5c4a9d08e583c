"""The way back beside the diagonal is the one of the whole table; chunks' texts are cut from bytes as from characters."""

import random

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.functions import edit


@pytest.mark.parametrize("letters", ["ab", "aeiou bcd", "abcdefghé😀 "])
def test_the_way_is_that_of_the_whole_table(letters):
    rng, near = random.Random(len(letters)), 0
    for n in [*range(1, 60), 300, 700, 1_500]:
        a = "".join(rng.choice(letters) for _ in range(n))
        noisy = "".join(c if rng.random() > 0.15 else rng.choice(["", rng.choice(letters), rng.choice(letters) + c]) for c in a)
        for b in (a.translate(str.maketrans("aeiou", "eaoiu")), noisy, a[::-1], a[n // 3 :] + a[: n // 3]):
            x, y = edit.codes(a, b)
            if len(x) and len(y):
                got = edit._back_nearby(x, y)
                near += got is not None
                assert got is None or got == edit._back(x, y)
    assert near > 150
    assert edit._back_nearby(*edit.codes("a" * 100, "b")) is None


def test_a_long_text_of_many_edits_needs_one_band(monkeypatch):
    """Its table has 1.6 billion cells, which were worked on twice."""
    monkeypatch.setattr(edit, "_back", None)
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.choice(list(b"etaoin shrdlu"), 40_000)))
    chunks = edit.align(text, text.translate(str.maketrans("aeiou", "eaoiu")))
    assert int(np.maximum(chunks[:, 2] - chunks[:, 1], chunks[:, 4] - chunks[:, 3])[chunks[:, 0] != 0].sum()) == edit.distance(text, text.translate(str.maketrans("aeiou", "eaoiu")))


def test_texts_of_chunks():
    refs = ["abcdefghij", "é😀" * 9, "", "same", "x"]
    hyps = ["abXdefghijk", "é😀x" * 9, "new é", "same", ""]
    got = [x for g in edit._char_chunks(iter([(pa.array(refs), pa.array(hyps))])) for x in g.to_pylist()]
    for r, h, chunks in zip(refs, hyps, got, strict=True):
        assert (r == h) == (not chunks)
        for c in chunks:
            assert (c["ref"], c["hyp"], c["before"], c["after"]) == (r[c["rs"] : c["re"]], h[c["hs"] : c["he"]], r[max(0, c["rs"] - edit.AROUND) : c["rs"]], r[c["re"] : c["re"] + edit.AROUND])
