import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from palimpsest.llm.free_packing import LEVELS, FreePlan, ShortestFirst, levels, pack_freely
from palimpsest.llm.queries import QUERIES, vocabulary
from tests.llm.helpers import EDGE_TEXTS, edge_docs, empty_docs

BYTE = vocabulary("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    """Longest first, each into the shortest pack that has room: rooms in the end."""
    packs = []
    for n in sorted(lengths, reverse=True):
        if packs and min(packs) + n <= capacity:
            at = packs.index(min(packs))
            packs[at] += n
        else:
            packs.append(n)
    return sorted(packs)


DRAWS = {
    "few tokens": lambda rng: np.clip(rng.exponential(300, 900).astype(int) + 1, 1, 2048),
    "uniform": lambda rng: rng.integers(300, 1501, 900),
    "above half": lambda rng: rng.integers(1025, 1500, 300),
    "tiny": lambda rng: rng.integers(1, 4, 900),
    "one length": lambda rng: np.full(777, 600),
    "one": lambda rng: np.array([100]),
    "full": lambda rng: np.full(5, 2048),
}


@pytest.mark.parametrize("name", DRAWS)
def test_the_histogram_packs_as_one_by_one(name):
    lengths = DRAWS[name](np.random.default_rng(7))
    packs = ShortestFirst(np.bincount(lengths, minlength=2049), 2048)
    fills = np.zeros(packs.packs, np.int64)
    spans = [set() for _ in fills]
    for n, _, first, many, offset in packs.flows:
        for p in range(first, first + many):
            fills[p] += n
            spans[p].add((offset, n))
    assert sorted(fills.tolist()) == one_by_one(lengths.tolist(), 2048)
    for own in spans:
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
    assert packs.room == int((2048 - fills).sum())
    for n in np.unique(lengths):
        ranks = sorted((rank, many) for m, rank, _, many, _ in packs.flows if m == n)
        assert [r for r, _ in ranks] == [0, *np.cumsum([m for _, m in ranks])[:-1]] and sum(m for _, m in ranks) == (lengths == n).sum()


def check(spans):
    """Sequences are gapless, full or of a power of two; how many aren't full."""
    short = 0
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 2048 or at < 2048 and not at & (at - 1)
        short += at < 2048
    assert short <= 11
    return short


@pytest.mark.parametrize("name", DRAWS)
@pytest.mark.parametrize("seed", range(3))
def test_plans_leave_no_padding(name, seed):
    lengths = DRAWS[name](np.random.default_rng(seed))
    level = levels(np.arange(len(lengths)), np.zeros(len(lengths), int))
    counts = np.zeros((2049, LEVELS), np.int64)
    np.add.at(counts, (lengths, level), 1)
    plan, spans, ranks, cuts = FreePlan(counts), {}, {}, 0
    for n, c in zip(lengths.tolist(), level.tolist(), strict=True):
        held = n >= plan.least and c >= plan.level
        rank = ranks[n, held] = ranks.get((n, held), -1) + 1
        if held:
            cut = plan.cut(n, rank)
            assert sum(x[1] for x in cut) == n and [x[0] for x in cut] == [0, *np.cumsum([x[1] for x in cut])[:-1]]
            cuts += len(cut) - 1
            for _, length, sequence, offset in cut:
                spans.setdefault(sequence, []).append((offset, length))
        else:
            sequence, offset = plan.place(np.array([n]), np.array([rank]))
            spans.setdefault(int(sequence[0]), []).append((int(offset[0]), n))
    check(spans)
    total = int(lengths.sum())
    assert len(spans) == total // 2048 + bin(total % 2048).count("1") == plan.sequences
    assert cuts <= 2 * len(spans) + 11


def test_levels_halve():
    got = levels(np.arange(200_000), np.arange(200_000) % 3)
    for c in (0, 2, 4, 8, 12):
        assert abs((got >= c).mean() - 2.0 ** (-c / 2)) < 0.01


def by_brute_force(rows, texts):
    """Every id of every text in exactly one piece, in order, with its checksum."""
    tokenizer, by_doc, spans = Tokenizer.from_file(BYTE), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return check(spans)


def test_op11_over_the_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op11_pack_freely"](spark, sf_dir).collect()
    by_brute_force(rows, texts)
    assert len(rows) < len(texts) + 3 * sum(r["length"] for r in rows) / 2048  # few cuts


def test_odd_rows(spark):
    docs = edge_docs(spark)
    rows = pack_freely(docs, BYTE).collect()
    once = [r for r in rows if r["doc_id"] is not None and r["doc_id"] != 5]
    spans = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    check(spans)
    tokenizer = Tokenizer.from_file(BYTE)
    for i, text in enumerate(EDGE_TEXTS):
        if i != 5:
            assert sum(r["length"] for r in once if r["doc_id"] == i) == len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 4 and sum(r["length"] for r in rows if r["doc_id"] is None) > 0
    assert pack_freely(empty_docs(spark), BYTE).count() == 0


def test_a_text_of_some_megabytes(spark):
    texts = {1: "one two " * 400_000, 2: "short", 3: None}
    rows = pack_freely(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), BYTE).collect()
    by_brute_force(rows, texts)
