import random
import zlib

from palimpsest.llm.line_dedup import line_dedup
from palimpsest.llm.queries import QUERIES
from palimpsest.llm.stages import drop_repeated_lines
from tests.llm.helpers import DOC_SCHEMA
from tests.llm.test_line_dedup import result, within_one

BLANK = " \t\n\v\f\r"


def brute(docs):
    """As in test_line_dedup, but lines under 20 code points are dropped too where they repeat, unless they are blank."""
    first, out = {}, {}
    for doc_id, text in sorted(docs):
        for pos, line in enumerate((text or "").split("\n")):
            if len(line) >= 20 or line.strip(BLANK):
                first.setdefault(line, (doc_id, pos))
    by_length = {}
    for line in first:
        by_length.setdefault(len(line), []).append(line)
    close = lambda s: any(first[t] < first[s] and within_one(s, t) for n in (-1, 0, 1) for t in by_length.get(len(s) + n, []) if len(t) >= 20 and t != s)
    near = {s for s in first if len(s) >= 20 and close(s)}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        here = [first.get(line) == (doc_id, pos) for pos, line in enumerate(lines)]
        stay = [line for line, h in zip(lines, here, strict=True) if line not in first or (h and line not in near)]
        n_near = sum(h and line in near for line, h in zip(lines, here, strict=True))
        out[doc_id] = (len(lines), len(lines) - len(stay) - n_near, n_near, "\n".join(stay))
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOC_SCHEMA)


def test_repeated_short_lines_go(spark):
    docs = [(1, "Erheed.\n\nyes\n \nyet"), (2, "yes\n\nErheed.\n \nno"), (3, "Erheed.\nyes")]
    assert result(line_dedup(frame(spark, docs))) == {1: (5, 0, 0, docs[0][1]), 2: (5, 2, 0, "\n \nno"), 3: (2, 2, 0, "")}
    assert {r["doc_id"] for r in drop_repeated_lines(frame(spark, docs)).collect()} == {1, 2}


def test_lines_around_the_guard(spark):
    rng, docs = random.Random(5), []
    bases = ["".join(rng.choice("abcd é\t") for _ in range(k)) for k in (1, 2, 18, 19, 20, 21, 22)] + [" " * 19, " " * 20, ""]
    for i in range(150):
        lines = [list(rng.choice(bases)) for _ in range(rng.randint(0, 4))]
        for line in lines:
            if line and rng.random() < 0.6:
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "a", " "])
        docs.append((i, "\n".join(map("".join, lines))))
    assert result(line_dedup(frame(spark, docs))) == brute(docs)


def test_over_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_lines"], r["n_exact"], r["n_near"], r["kept_chars"], r["kept_crc32"]) for r in QUERIES["op7_line_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (*w[:3], len(w[3]), zlib.crc32(w[3].encode())) for i, w in brute(docs).items()}
