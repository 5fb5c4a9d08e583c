"""Token ids by way of a memo of words: the tokenizer sees each word of a worker once."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: white space as the tokenizers' expressions see it
WHITE = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: control characters that only some take for white space
CONTROL = r"[\x1c-\x1f]"
#: words encoded in one call, with a special token between them that the tokenizer cuts out first, and characters at most
TOGETHER, TOGETHER_CHARS = 1_000, 1 << 20
#: bytes of text cut into words at once
CHUNK = 1 << 22
#: characters from which a word isn't remembered beyond the call that met it
LONGEST = 256


class _Index(dict):
    """Word to row of the id tables; a word not seen before gets the next row."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at


class WordIds:
    """Encodes texts exactly as ``tokenizer.encode(text, add_special_tokens=False)`` does.

    ``kind`` says where a text may be cut so that the parts encode alone as they do in place:
    ``spaceless``: the tokenizer drops white space, so at each white space; ``byte_level``: before each run of white space,
    which stays with the word behind it; ``whole``: nowhere, every text goes to the tokenizer. Texts with characters that would spoil the cut go to the tokenizer whole and
    aren't remembered. Beyond ``most`` words or ``most_chars`` characters of them the memo keeps the words that were seen
    most often, at most half of either; a call adds no more than its own texts.
    """

    def __init__(self, tokenizer, kind: str, most: int = 900_000, most_chars: int = 32_000_000) -> None:
        self.tokenizer, self.kind, self.most, self.most_chars = tokenizer, kind, most, most_chars
        special = [(i, t.content) for i, t in sorted(tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.divider = special[0] if special else None
        if kind == "byte_level":  # a token's letters stand for its bytes
            self.sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
            for token, i in tokenizer.get_vocab().items():
                self.sizes[i] = len(token)
        self._clear()

    def _encode_row(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that begin with white space: in a row they stay apart, and the bytes of tokens tell where each ends."""
        joined = "".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) if joined.isascii() else np.array([len(w.encode()) for w in words])
        upto = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(upto, prepend=0)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each on its own, and how many each has."""
        joined = self.divider[1].join(words) if self.divider else ""
        if self.divider and joined.count(self.divider[1]) == len(words) - 1:
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            between = np.flatnonzero(ids == self.divider[0])
            return ids[ids != self.divider[0]], np.diff(np.concatenate([[-1], between, [len(ids)]])) - 1
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def _clear(self) -> None:
        self.index, self.flat = _Index(), np.zeros(1 << 16, np.uint32)
        self.starts, self.lens, self.rows, self.used, self.chars = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0, 0
        self.seen = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        words, seen = list(self.index), self.seen[: self.rows]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        often = np.flatnonzero((seen > 1) & (sizes <= LONGEST))
        often = often[np.argsort(-seen[often], kind="stable")][: self.most // 2]
        kept = np.sort(often[: np.searchsorted(np.cumsum(sizes[often]), self.most_chars // 2)])
        lens = self.lens[kept]
        ends = np.cumsum(lens)
        self.flat = self.flat[np.repeat(self.starts[kept] - (ends - lens), lens) + np.arange(int(lens.sum()))] if len(kept) else np.zeros(1 << 16, np.uint32)
        self.index = _Index()
        for row, at in enumerate(kept.tolist()):
            dict.__setitem__(self.index, words[at], row)
        self.starts, self.lens, self.seen = ends - lens, lens, seen[kept] // 2  # what was seen long ago counts less
        self.rows, self.used, self.chars = len(kept), int(lens.sum()), int(sizes[kept].sum())
        self.flat, self.starts, self.lens = (np.concatenate([x, np.zeros(1 << 16, x.dtype)]) for x in (self.flat, self.starts, self.lens))

    def _learn(self) -> None:
        fresh, self.index.fresh = self.index.fresh, []
        self.chars += sum(map(len, fresh))
        if self.kind == "byte_level":
            plain = np.fromiter((w[:1] in (" ", "\n") and len(w) > 1 and w[1:].isprintable() and w[1] != " " for w in fresh), bool, len(fresh))
            self._learn_some([w for w, p in zip(fresh, plain.tolist(), strict=True) if p], self._encode_row, np.flatnonzero(plain))
            self._learn_some([w for w, p in zip(fresh, plain.tolist(), strict=True) if not p], self._encode, np.flatnonzero(~plain))
        else:
            self._learn_some(fresh, self._encode, np.arange(len(fresh)))
        self.rows += len(fresh)

    def _learn_some(self, fresh: list[str], encode, places: np.ndarray) -> None:
        """Adds words whose rows are ``places`` beyond those so far."""
        while self.rows + len(self.index) > len(self.lens):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        upto = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))
        at = 0
        while at < len(fresh):
            end = min(at + TOGETHER, max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER_CHARS, side="right"))))
            ids, lens = encode(fresh[at:end])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            rows = self.rows + places[at:end]
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts[rows] = self.used + np.cumsum(lens) - lens
            self.lens[rows] = lens
            self.used += len(ids)
            at = end

    def _cut(self, texts: pa.Array) -> pa.Array:
        """The words of each text, as lists."""
        if self.kind == "spaceless":
            return pc.utf8_split_whitespace(texts)
        if pc.any(pc.match_substring_regex(texts, f"{WHITE}{{2}}")).as_py():
            marked = pc.replace_substring_regex(texts, f"({WHITE}+)", "\0\\1")
        else:  # single white spaces; those that are rare may stay inside a word
            marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        return pc.split_pattern(marked, "\0")

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of each text's ids. A null text has none."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        if self.kind == "whole":
            got = [np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.fromiter(map(len, got), np.int64, len(got))
        if len(self.index) > self.most or self.chars > self.most_chars:
            self._shrink()
        odd = pc.match_substring_regex(texts, CONTROL) if self.kind == "spaceless" else pc.match_substring(texts, "\0")
        whole = {i: texts[i].as_py() for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        if whole:
            texts = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        parts, used, at = [], [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, side="right")))
            parts.append(self._encode_some(texts.slice(at, end - at), used))
            at = end
        if used:
            seen = np.bincount(np.concatenate(used), minlength=self.rows).astype(np.int32)
            seen[: len(self.seen)] += self.seen
            self.seen = seen
        ids, lens = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return self._with_whole(ids, lens, whole) if whole else (ids, lens)

    def _with_whole(self, ids: np.ndarray, lens: np.ndarray, whole: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
        """Puts in the ids of texts that go to the tokenizer whole."""
        ends, out, at, lens = np.cumsum(lens), [], 0, lens.copy()
        for i, text in whole.items():
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            out += [ids[at : ends[i]], got]
            at, lens[i] = int(ends[i]), lens[i] + len(got)
        return np.concatenate([*out, ids[at:]]), lens

    def _encode_some(self, texts: pa.Array, used: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lists = self._cut(texts)
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self.index.__getitem__, different), np.int32, len(different))[words.indices.to_numpy(zero_copy_only=False)]
        used.append(rows)
        if self.index.fresh:
            self._learn()
        lens = self.lens[rows]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[rows] - (ends - lens), lens) + np.arange(total)]
        return ids, np.diff(np.concatenate([[0], ends])[offsets - offsets[0]])


_CACHE: dict[str, WordIds] = {}


def kind_of(tokenizer) -> str:
    """Where a tokenizer's texts may be cut, by how it says that it takes them apart itself."""
    described = json.loads(tokenizer.to_str())
    before = described["pre_tokenizer"] or {}
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not described["normalizer"]:
        return "byte_level"
    first = (before.get("pretokenizers") or [{}])[0]
    if first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and "[^\\s" in first["pattern"].get("Regex", ""):
        return "spaceless"
    return "whole"


def word_ids(path: str) -> WordIds:
    """One encoder for each worker process."""
    if path not in _CACHE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _CACHE[path] = WordIds(tokenizer, kind_of(tokenizer))
    return _CACHE[path]
