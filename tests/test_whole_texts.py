"""What has no SQL over whole texts, against tables of distances kept in full."""

import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import edit
from palimpsest.functions.constants import ENTITIES, FORMULAIC
from palimpsest.operators import curation, scoring
from palimpsest.plans import views
from palimpsest.plans.registry import QUERIES


def steps(ref, hyp):
    """Cells of an optimal alignment: ``op, place in ref, place in hyp``; equal ends first, then from the end the diagonal, deletion, insertion."""
    start = 0
    while start < min(len(ref), len(hyp)) and ref[start] == hyp[start]:
        start += 1
    end = 0
    while end < min(len(ref), len(hyp)) - start and ref[-1 - end] == hyp[-1 - end]:
        end += 1
    known = {}
    a, b = (np.array([known.setdefault(x, len(known)) for x in s[start : len(s) - end]], np.int32) for s in (ref, hyp))
    n, m = len(a), len(b)
    table, across = np.zeros((n + 1, m + 1), np.int16), np.arange(m + 1)
    table[0] = across
    for i in range(1, n + 1):
        row = np.append(i, np.minimum(table[i - 1, :-1] + (b != a[i - 1]), table[i - 1, 1:] + 1))
        table[i] = np.minimum.accumulate(row - across) + across
    out, i, j = [], n, m
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("equal" if a[i] == b[j] else "substitute", start + i, start + j))
        elif i and table[i, j] == table[i - 1, j] + 1:
            i -= 1
            out.append(("delete", start + i, start + j))
        else:
            j -= 1
            out.append(("insert", start + i, start + j))
    return [("equal", k, k) for k in range(start)] + out[::-1] + [("equal", len(ref) - end + k, len(hyp) - end + k) for k in range(end)]


def runs(found):
    """Steps put together to ``op, ref from, ref to, hyp from, hyp to``."""
    out = []
    for op, i, j in found:
        if not out or out[-1][0] != op:
            out.append([op, i, i, j, j])
        out[-1][2] += op != "insert"
        out[-1][4] += op != "delete"
    return out


class Item:
    def __init__(self, row):
        self.folder, self.stem, self.ref, self.hyp = row["subfolder"], row["stem"], row["reference"], row["prediction"]
        self.chars = [s for s in steps(self.ref, self.hyp) if s[0] != "equal"]
        self.rw, self.hw = self.ref.split(), self.hyp.split()
        self.words = steps(self.rw, self.hw)
        r, h = ([w for w in t.split(" ") if w] for t in (self.ref, self.hyp))
        self.n_words, self.word_edits = len(r), sum(s[0] != "equal" for s in steps(r, h))
        self.against = dict.fromkeys(range(len(self.rw)), "") | {i: self.hw[j] for op, i, j in self.words if op in ("equal", "substitute")}


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return [Item(r) for r in views.pairs(spark, sf_dir).collect()]


def collected(spark, sf_dir, name):
    return [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


def distance(a, b):
    return sum(s[0] != "equal" for s in steps(a, b))


def test_words(spark, sf_dir, items):
    want = {i.stem: i.word_edits / i.n_words for i in items}
    got = {r["filename"]: r["wer"] for r in collected(spark, sf_dir, "a2_item_word_rates")}
    assert got == {k: pytest.approx(min(1.0, x), abs=1e-6) for k, x in want.items()}
    assert {r["stem"]: r["edits"] for r in collected(spark, sf_dir, "c2_word_levenshtein")} == {i.stem: i.word_edits for i in items}
    (micro,) = collected(spark, sf_dir, "a7_corpus_word_rates")
    assert micro["wer_micro"] == pytest.approx(sum(i.word_edits for i in items) / sum(i.n_words for i in items), abs=1e-6)
    for row in collected(spark, sf_dir, "a5_a6_word_report"):
        rates = [min(1.0, want[i.stem]) for i in items if row["is_total"] or i.folder == row["subfolder"]]
        assert (row["n"], row["wer_mean"], row["wer_median"]) == (len(rates), pytest.approx(statistics.fmean(rates), abs=1e-6), pytest.approx(statistics.median(rates), abs=1e-6))


def test_character_confusion(spark, sf_dir, items):
    every = Counter((op, i.ref[a] if op != "insert" else None, i.hyp[b] if op != "delete" else None) for i in items for op, a, b in i.chars)
    want = set()
    for op in ("substitute", "insert", "delete"):
        ranked = sorted((k for k in every if k[0] == op), key=lambda k: (-every[k], k[1] or "", k[2] or ""))
        want |= {(*k, every[k]) for k in ranked[:30]}
    assert {tuple(r[c] for c in ("op", "ref_char", "hyp_char", "n")) for r in collected(spark, sf_dir, "a10_character_confusion")} == want


def rate(pairs):
    return (len(pairs), pytest.approx(sum(distance(r, h) for r, h in pairs) / max(1, sum(len(r) for r, _ in pairs)), abs=1e-6))


def test_entities_and_lines(spark, sf_dir, items):
    found = {"baseline": [(i.ref, i.hyp) for i in items]} | {e: [] for e in ENTITIES}
    lines = {"formulaic": [], "free_text": []}
    for item in items:
        for entity, pattern in ENTITIES.items():
            span = 3 if entity == "dates" else 1
            for k in range(len(item.rw)):
                text = " ".join(item.rw[k : k + span])
                hits = len(re.findall(pattern, text, re.IGNORECASE))
                found[entity] += [(text, " ".join(item.against.get(k + x, "") for x in range(span)))] * hits
        at = 0
        for line in item.ref.split("\n"):
            n = len(line.split())
            kind = "formulaic" if re.search("|".join(FORMULAIC), line, re.IGNORECASE) else "free_text"
            lines[kind].append((line.strip(), " ".join(item.against[at + x] for x in range(n)).strip()))
            at += n
    assert {r["entity"]: (r["n"], r["cer"]) for r in collected(spark, sf_dir, "a11_entity_rates")} == {e: rate(p) for e, p in found.items() if p}
    assert {r["kind"]: (r["n"], r["cer"]) for r in collected(spark, sf_dir, "a12_formulaic_rates")} == {k: rate(p) for k, p in lines.items() if p}


def test_spaces_and_inventions(spark, sf_dir, items):
    found, invented = [], []
    for item in items:
        for seq, (_, a, b, c, d) in enumerate(runs(item.chars) if not item.chars else [x for x in runs(steps(item.ref, item.hyp)) if x[0] != "equal"]):
            ref, hyp = item.ref[a:b], item.hyp[c:d]
            kinds = [("merge", 5)] * (" " in ref and " " not in hyp) + [("split", 5)] * (" " not in ref and " " in hyp) + [("apostrophe", 8)] * ("'" in ref or "'" in hyp)
            found += [(kind, item.stem, seq, item.ref[max(0, a - k) : b + k], ref or "∅", hyp or "∅") for kind, k in kinds]
        for seq, (op, _, _, c, d) in enumerate(runs(item.words)):
            if op == "insert" and d - c >= 3:
                invented.append((item.folder, item.stem, seq, " ".join(item.hw[c:d]), d - c))
    assert {r["kind"]: r["n"] for r in collected(spark, sf_dir, "a13_space_apostrophe")} == Counter(x[0] for x in found)
    want = [x for kind in ("merge", "split", "apostrophe") for x in sorted(y for y in found if y[0] == kind)[:20]]
    assert {tuple(r[c] for c in ("kind", "stem", "seq", "context", "ref", "hyp")) for r in collected(spark, sf_dir, "t3_space_examples")} == set(want)
    (totals,) = collected(spark, sf_dir, "a16_hallucinations")
    assert (totals["total_hallucinations"], totals["total_words"]) == (len(invented), sum(x[4] for x in invented))
    longest = sorted(invented, key=lambda x: (-x[4], x[:3]))[:20]
    assert [tuple(r[c] for c in ("subfolder", "stem", "seq", "inserted_text", "n_words")) for r in collected(spark, sf_dir, "t2_longest_hallucinations")] == longest


@pytest.mark.parametrize("kept", [1 << 25, 0])
def test_alignments_in_pieces(monkeypatch, kept):
    monkeypatch.setattr(edit, "KEPT_BYTES", kept)
    rng = random.Random(kept)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 20))) for _ in range(2))
        assert [tuple(x) for x in edit.align(a, b).tolist()] == [(["equal", "substitute", "delete", "insert"].index(op), *rest) for op, *rest in runs(steps(a, b))]


def test_long_texts_are_aligned_in_little_memory():
    import tracemalloc

    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    b = "".join(x if rng.random() > 0.05 else rng.choice("xyz") for x in a)
    tracemalloc.start()
    found = edit.align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000  # a table would have 6.4 GB
    changed = found[found[:, 0] != edit.EQUAL]
    assert sum(max(x[2] - x[1], x[4] - x[3]) for x in changed.tolist()) == edit.distance(a, b) > 1000


def test_medians(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, 1.0, rng.random(), rng.random() * 3])) for _ in range(501)] + [("c", 0.5), ("d", None), ("e", 0.1), ("e", 0.9)]
    got = {r["g"]: r["x_median"] for r in scoring.medians(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert got == {g: pytest.approx(statistics.median(x for k, x in rows if k == g)) for g in ("a", "b", None, "c", "e")}


def test_capped_over_a_frequent_text(spark):
    rows = [(i, "the same text" if i % 2 else f"text {i % 30}") for i in range(2000)] + [(5000, "ab"), (5001, None)]
    want, seen = set(), Counter()
    for i, t in rows:
        if t and len(t) > 2:
            seen[t] += 1
            want |= {i} if seen[t] <= 20 else set()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r["doc_id"] for r in curation.capped(df, "doc_id", share=0.01).collect()} == want


def test_shares_equal_page_by_page():
    rng = random.Random(4)
    for _ in range(300):
        sizes = {rng.randint(1, 30): rng.randint(1, 40) for _ in range(rng.randint(1, 6))}
        total, held, want = sum(a * b for a, b in sizes.items()), [0, 0, 0], []
        for size in sorted(sizes, reverse=True):
            took = [0, 0, 0]
            for _ in range(sizes[size]):
                need = [w * total - 10 * h for w, h in zip((7, 2, 1), held, strict=True)]
                i = need.index(max(need))
                held[i], took[i] = held[i] + size, took[i] + 1
            want.append((size, *took[:2]))
        assert curation.shares(sizes, total) == want


def test_many_splits(spark, tmp_path):
    """More splits than any list on the driver should hold."""
    from palimpsest.sinks import files as sinks

    names = [f"s{i:03}" for i in range(150)] + ["train", "dev"]
    rows = spark.createDataFrame([(f"{n}.jpg", n) for n in names], "filename string, split string")
    sinks.write_annotations(rows, str(tmp_path / "a"))
    back = spark.read.schema("filename string").json(str(tmp_path / "a"))
    assert back.count() == len(names) and (tmp_path / "a" / "split=test").is_dir()
    docs = spark.createDataFrame([(i, n) for i, n in enumerate([*names, "test"] * 20)], "doc_id long, split string")
    assert curation.complete_splits(docs, "doc_id").filter("split = 'validation'").count() == 2


def test_written_texts_and_copies(spark, tmp_path):
    from palimpsest.sinks import files as sinks

    rows = spark.createDataFrame([("a", "1", "one é"), ("", "2", "two"), ("a/b", "3", None)], "subfolder string, stem string, text string")
    base = str(tmp_path / "out")
    assert sinks.write_texts(rows, base).filter("written").count() == 3
    assert (tmp_path / "out" / "a" / "1.md").read_text() == "one é"
    assert sinks.write_texts(rows, base).filter("written").count() == 0
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length")
    assert sinks.copy_files(files, f"file://{base}", str(tmp_path / "copy"), [".md"]).filter("copied").count() == 2  # Spark lists no empty file
    assert (tmp_path / "copy" / "a" / "1.md").read_text() == "one é"
    assert sinks.delete_tree(spark, str(tmp_path / "copy")) and not (tmp_path / "copy").exists()
    text = sinks.metrics_text(scoring.report(spark.createDataFrame([("a", 0.1, 0.2, 3, 0.0)], "subfolder string, cer double, wer double, levenshtein int, exact_match double")))
    assert text.splitlines()[-1].startswith("ALL") and F is not None
