"""Token counts by heap-and-linked-list byte-pair merging; no ids are made."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.base import map_arrow, pick

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
LONGEST_KEPT = 64


class PieceCounter:
    """Counts the tokens that a sentencepiece BPE model with byte fallback gives.

    A segment is a run of marks (the model's spaces) with what follows up to the next mark. As no piece of the model has
    a mark after another character (checked), no merge crosses segments, so each distinct segment is merged once.
    """

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(self.model.vocab_size()):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.rank[self.model.id_to_piece(i)] = -self.model.get_score(i)
        self.cuts_at_marks = all(re.fullmatch(f"{MARK}*[^{MARK}]*", piece) for piece in self.rank)
        self.cuts_at_newlines = self.cuts_at_marks and not any("\n" in piece for piece in self.rank)
        self.plain = self.model.normalize("a  b\nﬁ c ") == f"{MARK}a{MARK}{MARK}b\nﬁ{MARK}c{MARK}"
        self.most, self.memo = most, {}

    def merged(self, symbols: str) -> int:
        """Initial symbols minus merges; a character outside the vocabulary counts as its bytes."""
        n, rank = len(symbols), self.rank
        part: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, pair) for i in range(n - 1) if (r := rank.get(pair := symbols[i : i + 2])) is not None]
        heapify(heap)
        count = n
        while heap:
            _, i, pair = heappop(heap)
            left, j = part[i], after[i]
            if left is None or j >= n or left + part[j] != pair:
                continue  # one of the two has merged meanwhile
            part[i], part[j] = pair, None
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r := rank.get(both := pair + part[k])) is not None:
                    heappush(heap, (r, i, both))
            h = before[i]
            if h >= 0 and (r := rank.get(both := part[h] + pair)) is not None:
                heappush(heap, (r, h, both))
        for x in part:
            if x is not None and x not in rank:
                count += len(x.encode()) - 1
        return count

    def _segment(self, segment: str) -> int:
        got = self.memo.get(segment)
        if got is None:
            got = self.merged(segment)
            if len(segment) <= LONGEST_KEPT:
                self.memo[segment] = got
        return got

    def _word(self, word: str) -> int:
        """A word as ``count`` cuts it: after a NUL it starts a line, else a mark stands before it."""
        got = self.merged(word[1:]) + 1 if word[:1] == "\0" else self.merged(MARK + word)
        if len(word) <= LONGEST_KEPT:
            self.memo["\1" + word] = got
        return got

    def count(self, text: str) -> int:
        if len(self.memo) > self.most:
            self.memo.clear()
        if not text:
            return 0
        if self.plain and self.cuts_at_newlines and text[0] != " " and "  " not in text and " \n" not in text and "\0" not in text and MARK not in text and "\1" not in text:
            get, total = self.memo.get, 0
            for word in text.replace("\n", " \0").split(" "):
                got = get("\1" + word)
                total += self._word(word) if got is None else got
            return total
        normal = self.model.normalize(text)
        return sum(map(self._segment, SEGMENT.findall(normal))) if self.cuts_at_marks else self.merged(normal)


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs(doc_id, text)``; no shuffle.

    A null or empty text has no bytes and no tokens. Repeated rows are counted each; a null doc_id stays null.
    Strings that look like special tokens are plain text, as by the library's default. ``model`` is read by executors.
    Texts are counted whole, one at a time, however long. An empty table gives no row. Other columns, also ones with
    clashing names, are left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(pick(docs, "doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
