"""Sets of hashed word shingles, made for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: bytes hashed at once
CHUNK = 1 << 22

_rng = np.random.default_rng(20_240_501)
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
PLACES = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTES[65:91] = BYTES[97:123]  # A-Z hash as a-z


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of BASE modulo 2^64, as many as the longest word so far needed."""

    table = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> np.ndarray:
        if n > len(cls.table):
            steps = np.full(max(n, 2 * len(cls.table)), BASE, np.uint64)
            steps[0] = 1
            cls.table = np.cumprod(steps)
        return cls.table


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of bytes that begin and end with white space or a border."""
    solid = ~SPACE[data]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    values = BYTES[data[solid]] * _Powers.of(int(lens.max()))[place]
    return starts, mix(np.add.reduceat(values, first) + lens.astype(np.uint64))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text (null: empty) its distinct shingles as sorted 64-bit hashes; fewer than WIDTH words are one shingle."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        # a space between texts keeps their words apart
        lens = np.diff(offsets[at : upto + 1])
        if upto == at + 1:
            starts, hashes = _long_text(data[offsets[at] : offsets[upto]])
            bounds = np.array([0, len(hashes)])
        else:
            joined = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
            begin = np.cumsum(lens + 1) - lens - 1
            keep = np.ones(len(joined), bool)
            keep[begin + lens] = False
            joined[keep] = data[offsets[at] : offsets[upto]]
            starts, hashes = word_hashes(joined)
            bounds = np.searchsorted(starts, np.append(begin, len(joined)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield _shingles(hashes[a:b])
        at = upto


def _long_text(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, in pieces cut at white space."""
    parts, at = [], 0
    while at < len(data):
        upto = min(len(data), at + CHUNK)
        while upto < len(data) and not SPACE[data[upto]]:
            upto += 1
        parts.append(word_hashes(data[at:upto])[1])
        at = upto
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return np.arange(len(hashes)), hashes


def _shingles(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if n == 0:
        return words
    width = min(n, WIDTH)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * PLACES[k]
    return np.unique(mix(total))
