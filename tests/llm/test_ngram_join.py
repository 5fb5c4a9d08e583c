import random
import re

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import ngram_join as module
from palimpsest.llm.components import components
from palimpsest.llm.ngram_join import chosen, jaccard_groups, roles
from palimpsest.llm.queries import QUERIES
from palimpsest.llm.shingles import shingle_sets
from tests.llm.helpers import DOC_SCHEMA, EDGE_TEXTS, edge_docs, empty_docs


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    tried = set()
    for ids in holders.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def edited(seed, n, words, most):
    """Groups of texts of all sizes with a few words changed, and passages that many share."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(words) for _ in range(30))
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 9, 14, 30, 66, 70, 100, 250, 300, 400]))] for _ in range(12)]
    out = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(text) // most))):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        joined = " ".join(text)
        out.append((i, f"{joined}\n{passage}" if rng.random() < 0.4 else joined))
    return out


WORDS = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize(("seed", "most"), [(1, 20), (2, 45), (3, 60)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, most):
    if seed > 1:
        monkeypatch.setattr(module, "COUNTED", 3)
        monkeypatch.setattr(module, "STAR", 4)
        monkeypatch.setattr(module, "MEMBERS", 7)
        monkeypatch.setattr(module, "BLOCK", 5)
        monkeypatch.setattr(module, "COLUMNS", 64)
        monkeypatch.setattr(module, "SPLIT", 6)
        monkeypatch.setattr(module, "ENTRIES", 900)
    if seed > 2:
        monkeypatch.setattr(module, "SENT", 0)
    docs = edited(seed, 260, WORDS, most)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOC_SCHEMA)
    assert result(jaccard_groups(df)) == brute(docs)


def test_op2_over_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert result(QUERIES["op2_ngram_join"](spark, "/root/testdata/sf0.01")) == brute(docs)


def test_shingle_sets(monkeypatch):
    texts = [*EDGE_TEXTS, "A b C d E f", "a B c D e F", "é É", "x" * 5000, "one two three four five six one two three four five six"]
    sizes = [len(s) for s in shingle_sets(pa.array(texts))]
    assert sizes == [len(shingles(t)) for t in texts]
    monkeypatch.setattr("palimpsest.llm.shingles.CHUNK", 16)
    again = list(shingle_sets(pa.array(texts)))
    assert [len(s) for s in again] == sizes
    assert again[len(EDGE_TEXTS)].tolist() == again[len(EDGE_TEXTS) + 1].tolist()


def test_similar_sets_always_meet(monkeypatch):
    monkeypatch.setattr(module, "MAP_BITS", 16)
    rng = np.random.default_rng(0)
    for trial in range(400):
        size = int(rng.choice([1, 2, 4, 5, 9, 30, 63, 127, 128, 129, 155, 161, 200, 255, 256, 300, 1100]))
        a = np.unique(rng.integers(1, 1 << 62, size, dtype=np.uint64))
        drop, add = int(rng.integers(0, size // 8 + 2)), int(rng.integers(0, size // 8 + 2))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(1, 1 << 62, add, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        every = [np.concatenate([np.concatenate([p, *[np.append(w, np.uint64(o)) for o, w in r]]) for p, r in (module.signatures(s, k) for k, _ in roles(len(s)))]) & module.LOW for s in (a, b)]
        both_have = np.intersect1d(*every)
        some = rng.permutation(np.unique(np.concatenate(every)))
        some = np.unique(some[: int(len(some) * rng.choice([0, 0.3, 0.9]))])
        shared = np.zeros(1 << (module.MAP_BITS - 3), np.uint8)
        cells = module.Costs.cells(np.concatenate([both_have, some]))
        np.bitwise_or.at(shared, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
        costs = module.Costs(shared, some, np.array([hash(int(x)) % 20 + 2 for x in some], np.int64))
        given = []
        for s in (a, b):
            parts = [chosen(s, k, h, costs) for k, h in roles(len(s))]
            given.append((set(np.concatenate([p[0] for p in parts]).tolist()), set(np.concatenate([p[1] for p in parts]).tolist())))
        (whole_a, less_a), (whole_b, less_b) = given
        assert whole_a & whole_b or whole_a & less_b or less_a & whole_b, (trial, size)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7), (1000, 999), (999, 1000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    docs = edge_docs(spark)
    got = jaccard_groups(docs)
    assert got.count() == docs.count()
    by_id = result(got)
    for i in (0, 1, 2, 3, 4):
        assert by_id[i] == (0, i)
    assert by_id[24] == by_id[23] == (1, 23) or EDGE_TEXTS[23] != EDGE_TEXTS[24]
    assert jaccard_groups(empty_docs(spark)).count() == 0
