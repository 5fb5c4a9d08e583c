"""Edit distances of many pairs at once: bit vectors of all pairs in step, so that a step's cost is shared.

A column of a pair's table is a row of 64-bit words. Word ``w`` works on column ``t - w`` in step ``t``, when the word above it
has ended that column, so all words of all pairs take the same step. Rows below a pair's last one, columns behind its last
one and steps before a word's first column change nothing that is read.
"""

from __future__ import annotations

import numpy as np

#: words that take a step together; how many times the words of the shortest a group's longest has
TOGETHER, MIXED = 8_192, 1.5
#: bytes of a group's tables, which grow with the codes that its pairs have
TABLES = 1 << 25
ONE, LAST = np.uint64(1), np.uint64(63)


def distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Levenshtein distances of pairs of codes, the longer sequence first, neither empty."""
    words = [-(-len(a) // 64) for a, _ in pairs]
    kinds = [len(np.unique(a)) + 1 for a, _ in pairs]
    order = sorted(range(len(pairs)), key=lambda k: (words[k], len(pairs[k][1])))
    out, first = [0] * len(pairs), 0
    while first < len(order):
        last, rows = first + 1, kinds[order[first]]
        while last < len(order) and words[order[last]] * (last + 1 - first) <= TOGETHER and words[order[last]] <= words[order[first]] * MIXED + 8:
            rows += kinds[order[last]]
            if rows * words[order[last]] * 8 > TABLES:
                break
            last += 1
        group = order[first:last]
        for k, d in zip(group, _in_step([pairs[k] for k in group]).tolist(), strict=True):
            out[k] = d
        first = last
    return out


def _in_step(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    count, wide, ends = len(pairs), int(-(-n.max() // 64)), (n - 1) // 64
    steps = int((m + ends).max())
    # places of a code's bits for each step, last step first; row 0 of a pair's table is no code's and has no bits
    rows, base, within = np.zeros((count, wide + steps), np.int64), 0, np.arange(wide)
    table = np.empty(sum(len(np.unique(a)) + 1 for a, _ in pairs) * wide, np.uint64)
    for k, (a, b) in enumerate(pairs):
        known, code = np.unique(a, return_inverse=True)
        places = np.zeros((len(known) + 1, wide * 64), np.uint8)
        places[code + 1, np.arange(len(a))] = 1
        size = places.size // 64
        table[base : base + size] = np.packbits(places, axis=1, bitorder="little").view(np.uint64).ravel()
        rows[k] = base
        other = np.minimum(np.searchsorted(known, b), len(known) - 1)
        rows[k, steps - len(b) : steps] += np.where(known[other] == b, other + 1, 0)[::-1] * wide
        base += size
    up, down = np.full((count, wide), ~np.uint64(0)), np.zeros((count, wide), np.uint64)
    rises, falls = np.zeros((count, wide), np.uint64), np.zeros((count, wide), np.uint64)
    rises[:, 0] = 1
    at, bit, score = np.arange(count) * wide + ends, ((n - 1) % 64).astype(np.uint64), n.copy()
    same, either, flat, rise = (np.empty_like(up) for _ in range(4))
    place = np.empty((count, wide), np.int64)
    for t in range(steps):
        np.add(rows[:, steps - 1 - t : steps - 1 - t + wide], within, out=place)
        np.take(table, place, out=same, mode="clip")
        np.bitwise_or(same, down, out=either)
        same |= falls
        np.bitwise_and(same, up, out=flat)
        flat += up
        flat ^= up
        flat |= same
        np.bitwise_or(flat, up, out=rise)
        np.invert(rise, out=rise)
        rise |= down
        flat &= up  # where a row falls
        now = (t >= ends) & (t < ends + m)
        score += np.where(now, ((rise.ravel()[at] >> bit) & ONE).astype(np.int64) - ((flat.ravel()[at] >> bit) & ONE).astype(np.int64), 0)
        np.left_shift(rise, ONE, out=same)
        same |= rises
        np.left_shift(flat, ONE, out=up)
        up |= falls
        np.right_shift(rise[:, :-1], LAST, out=rises[:, 1:])
        np.right_shift(flat[:, :-1], LAST, out=falls[:, 1:])
        np.bitwise_and(same, either, out=down)
        same |= either
        np.invert(same, out=same)
        up |= same
    return score
