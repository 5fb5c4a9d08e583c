import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm.queries import SQL
from palimpsest.llm.stages import mixed, one_of_each_group
from palimpsest.session import stash
from tests.llm import test_line_dedup, test_mixing, test_ngram_join
from tests.llm.helpers import DOC_SCHEMA, edge_docs, empty_docs
from tests.llm.test_tokens import check_packing
from tests.oracle import connect

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, schema = docs.columns, docs.dtypes
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF), "test")
        outs.append(docs)
    quality, lines, groups, mix, packed = outs
    assert all(o.columns == columns and o.dtypes == schema for o in outs[:4])
    rows = [{r["doc_id"]: r for r in o.collect()} for o in outs[:3]]

    kept = {r[0] for r in connect(SF).sql(f"SELECT doc_id FROM ({SQL['op4_quality']}) WHERE kept").fetchall()}
    assert set(rows[0]) == kept

    texts = {i: r["text"] for i, r in rows[0].items()}
    want = {i: x[3] for i, x in test_line_dedup.brute(list(texts.items())).items() if x[3].strip(" \t\n\v\f\r")}
    assert {i: r["text"] for i, r in rows[1].items()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] == rows[0][i]["lang"] and r["source"] == rows[0][i]["source"] for i, r in rows[1].items())

    component = test_ngram_join.brute(list(want.items()))
    assert set(rows[2]) == {i for i, (_, c) in component.items() if i == c}

    held = {i: r for i, r in rows[2].items()}
    taken = Counter(r["doc_id"] for r in mix.collect())
    words = lambda t: len((t or "").split())
    sizes, got = Counter(), Counter()
    for i, r in held.items():
        sizes[r["source"]] += words(r["text"])
        got[r["source"]] += taken[i] * words(r["text"])
    goal = test_mixing.brute_targets(dict(sizes))
    longest = max(words(r["text"]) for r in held.values())
    assert set(taken) <= set(held) and max(taken.values()) <= 2
    assert all(goal[s] - 1 <= got[s] <= goal[s] + longest for s in sizes)

    pieces = packed.collect()
    check_packing(pieces)
    tokenizer, expected = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for i, n in taken.items():
        ids = [*tokenizer.encode(held[i]["text"], add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            expected[i, k // 2048, zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += n
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces) == expected


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and check_packing(rows)


def test_edges(spark):
    for make in (edge_docs, empty_docs):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            out.count()


def test_repeated_rows_count_once(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "s", 1)] * 3 + [(2, text, "en", "s", 1), (None, text, "en", "s", 1), (None, "another one", "en", None, 1)], DOC_SCHEMA)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(r["text"]) > 50) for r in one_of_each_group(docs).collect()) == [(False, 0, False), (True, 1, True)]
    assert mixed(docs).count() >= 6
