"""Word distances hold neither the words of a batch as objects nor large tables."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.functions import edit
from palimpsest.operators import scoring


def pairs_of(n):
    rng = random.Random(7)
    out = [(None, "a"), ("a", None), ("", ""), ("  ", "a b"), (" a  b ", "a b"), ("a\nb c", "a b c"), ("é é", "é"), ("a b", "")]
    for _ in range(n):
        words = [rng.choice(["the", "cat", "é", "", "sat", "on\n"]) for _ in range(rng.randrange(80))]
        out.append((" ".join(words), " ".join(w for w in words if rng.random() < 0.8)))
    return out


def test_distances_of_words_by_their_numbers(monkeypatch):
    pairs = pairs_of(120)
    split = lambda t: None if t is None else [w for w in t.split(" ") if w]
    want = [None if a is None or b is None else edit.distance(split(a), split(b)) for a, b in pairs]
    monkeypatch.setattr(edit, "WORDS_SHARED", 300)
    texts = [pa.array(t, pa.string()) for t in zip(*pairs, strict=True)]
    lists = [pa.array([split(t) for t in side], pa.list_(pa.string())) for side in zip(*pairs, strict=True)]
    for given, run in ((texts, edit._text_word_distances), ([t.slice(3) for t in texts], edit._text_word_distances), (lists, edit._distances), ([t.slice(3) for t in lists], edit._distances)):
        got = list(run(iter([tuple(given)])))
        assert len(got) > 5 and [x for g in got for x in g.to_pylist()] == want[-len(given[0]) :]
    assert edit.distances([["a", None]], [["a", "b"]]) == [1]


def test_rates_with_either_separator(spark):
    df = spark.createDataFrame([("s", str(i), a, b) for i, (a, b) in enumerate(pairs_of(20)) if a and b], "subfolder string, stem string, prediction string, reference string").filter("trim(reference) <> ''")
    plan = scoring.item_metrics(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "_text_word_distances" in plan and "array<" not in plan  # words aren't sent
    rows = {r["filename"]: r["wer"] for r in scoring.item_metrics(df, clip=False).collect()}
    for r in df.collect():
        a, b = ([w for w in r[c].split(" ") if w] for c in ("reference", "prediction"))
        assert rows[r["stem"]] == edit.distance(a, b) / len(a)
    assert scoring.item_metrics(df, separator=None).agg(F.count("wer")).first()[0] == len(rows)


def test_memory_of_many_words():
    """A hundred texts of 3000 words, nearly all of them different: 32 MB of tables at once, where all came to 270."""
    rng = np.random.default_rng(1)
    rows = [[f"w{x}" for x in rng.permutation(3_000)] for _ in range(100)]
    lists = pa.array(rows), pa.array([r[::2] + r[1::2] for r in rows])
    tracemalloc.start()
    got = [x for g in edit._distances(iter([lists])) for x in g.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 100 and got[0] == edit.distance(rows[0], rows[0][::2] + rows[0][1::2]) and peak < 120e6, peak
