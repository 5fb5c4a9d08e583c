import math
import re
from collections import Counter

import pytest

from palimpsest.llm import quality
from palimpsest.llm.queries import QUERIES
from palimpsest.llm.quality import quality_rules
from tests.llm.helpers import DOC_SCHEMA, EDGE_TEXTS, edge_docs, empty_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, lang):
    """The counts and the verdict of one text."""
    text, words = text or "", WORD.findall(text or "")
    n, windows, covered = len(words), Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(n - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = n < 50 or 100 * len(covered) > 50 * n
    sets = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[!-/:-@\[-`{-~]"]
    classes = [len(re.findall(x, text)) for x in sets]
    classes.append(len(text) - sum(classes))
    bare = Counter(WORD.findall(re.sub(r"""[.,;:!?"'()]+""", "", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))))

    def apart(counts, table):
        total = max(1, sum(counts))
        pairs = [(x / total, y / 1000) for x, y in zip(counts, table, strict=True)]
        one = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
        return math.sqrt(max(0.0, sum(one(x, y) + one(y, x) for x, y in pairs) / 2))

    chars = min(apart(classes, quality.PROSE[k]) for k in ([lang] if lang in quality.PROSE else quality.PROSE)) if len(text) >= 200 else 0.0
    far = 0.0
    if lang in quality.COMMON and n >= 50:
        table = quality.COMMON[lang]
        hits = [bare[w] for w in table]
        far = apart([*hits, n - sum(hits)], [*table.values(), 1000 - sum(table.values())])
    kept = not failed and chars <= 0.2 and far <= 0.2 + 1.5 / math.sqrt(max(1, n))
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, kept), chars, far


def checked(df):
    rows = df.select("doc_id", "text", "lang").collect()
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    for row in rows:
        want, chars, far = brute(row["text"], row["lang"])
        r = got[row["doc_id"]]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) == want, row
        assert (r["class_distance"], r["word_distance"]) == (pytest.approx(chars, abs=1e-9), pytest.approx(far, abs=1e-9))
    return len(rows)


def test_over_the_table(spark, sf_dir):
    assert checked(spark.read.parquet(f"{sf_dir}/documents.parquet")) == 200


def test_edges(spark):
    df = spark.createDataFrame([(i, t, ["en", None, "xx", "de"][i % 4], "s", 1) for i, t in enumerate(EDGE_TEXTS)], DOC_SCHEMA)
    assert checked(df) == len(EDGE_TEXTS)
    rows = edge_docs(spark)
    got = quality_rules(rows)
    assert got.count() == rows.count() and got.filter("kept is null or base_failed is null").count() == 0
    assert quality_rules(empty_docs(spark)).count() == 0


def test_a_text_of_some_megabytes(spark):
    prose = "The cat sat on the mat, and it was glad of it; for a dog is not at home with a cat.\n"
    long = " ".join(f"{prose}w{i}" for i in range(20_000))
    assert checked(spark.createDataFrame([(1, long, "en", "s", 1), (2, "| " * 1_000_000, "en", "s", 1)], DOC_SCHEMA)) == 2


def test_one_verdict_whatever_the_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules(docs).filter("kept").collect()}
    some = docs.filter("doc_id % 7 = 3")
    assert {r["doc_id"] for r in quality_rules(some).filter("kept").collect()} == {i for i in kept if i % 7 == 3}


def test_labels(spark):
    """Held against the labels of the largest table: clean documents that pass the base stay, others go."""
    sf = "/root/testdata/sf0.1"
    judged = {r["doc_id"]: r for r in QUERIES["op4_quality"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [judged[i]["kept"] for i, q in labels.items() if q == 1 and not judged[i]["base_failed"]]
    junk = [judged[i]["kept"] for i, q in labels.items() if q == 0]
    assert sum(clean) >= 0.995 * len(clean) > 1000 and sum(junk) <= 0.03 * len(junk) and len(junk) > 100
