"""Edit distances over characters and words, and alignments.

Both first follow diagonals: how far each diagonal of the table of distances is reached with no edit, one, two and so on.
That takes about as many steps as the text is long and the square of the number of edits. Where there are too many edits
for that, both work by bit vectors: a column of the table is two long integers (where the distance rises and where it falls
by one), so a text of any length takes about a thirtieth of a step for each cell and no table is kept. A text that has all of the
other's elements in order differs by its length alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from palimpsest.functions import side_by_side

#: bytes of columns kept at once on the way back; beyond, columns are worked out again in pieces
KEPT_BYTES = 1 << 25
EQUAL, SUBSTITUTE, DELETE, INSERT = range(4)
NAMES = np.array(["equal", "substitute", "delete", "insert"])
#: elements compared at once along a diagonal; a place that isn't reached
WINDOW, NOWHERE = 16, -(1 << 30)
STEPS = np.arange(WINDOW)
#: positions of an element from which its bits are kept between uses
FREQUENT = 8


def char_rate(reference: Column, prediction: Column) -> Column:
    """Edits for each reference character, unclipped; null for an empty reference."""
    return F.try_divide(char_distance(reference, prediction).cast("double"), F.char_length(reference).cast("double"))


def codes(ref: str | list | np.ndarray, hyp: str | list | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences as numbers, equal where their elements are; numbers stay."""
    if isinstance(ref, np.ndarray):
        return ref, hyp
    if isinstance(ref, str):
        return np.frombuffer(ref.encode("utf-32-le", "surrogatepass"), "<u4"), np.frombuffer(hyp.encode("utf-32-le", "surrogatepass"), "<u4")
    known: dict = {}
    return tuple(np.fromiter((known.setdefault(x, len(known)) for x in s), np.uint32, len(s)) for s in (ref, hyp))


def ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many elements are equal at the start, and of the others at the end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    n -= start
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1]) if n else differ
    return start, int(differ[0]) if len(differ) else n


class Places(dict):
    """Element to the bits of its places in a sequence."""

    def __init__(self, a: np.ndarray) -> None:
        super().__init__()
        order = np.argsort(a, kind="stable")
        cuts = np.flatnonzero(np.diff(a[order], prepend=a[order[:1]] + 1)).tolist() if len(a) else []
        self.at = {int(a[order[i]]): order[i:j] for i, j in zip(cuts, [*cuts[1:], len(a)][: len(cuts)], strict=True)}

    def __missing__(self, x: int) -> int:
        at = self.at.get(x)
        if at is None:
            return 0
        if len(at) < FREQUENT:
            return sum(1 << p for p in at.tolist())
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        self[x] = out = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        return out


def _most_edits(n: int, m: int, keep: bool) -> int:
    """Edits up to which diagonals are followed: while they take at most an eighth of the time of bit vectors (microseconds, as
    measured: 60 for each number of edits and 0.3 for each diagonal), and while what is kept of them for the way back fits."""
    vectors = min(n, m) * (2 + 0.00022 * max(n, m))
    most = int(((3_600 + 1.2 * vectors / 8) ** 0.5 - 60) / 0.6)
    return min(most, int((KEPT_BYTES / 4) ** 0.5)) if keep else most


def _slide(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``i`` moved past all equal elements from each place on. Both sequences end with ``WINDOW`` marks that equal nothing."""
    out = i.copy()
    live = np.flatnonzero(a[i] == b[j])
    while len(live):
        if len(live) <= 4:  # few long runs: one by one, in growing pieces
            for at in live.tolist():
                x, y, size = int(out[at]), int(j[at] + out[at] - i[at]), 64
                while True:
                    differ = np.flatnonzero(a[x : x + size] != b[y : y + size]) if x + size <= len(a) and y + size <= len(b) else None
                    if differ is None:
                        left = min(len(a) - x, len(b) - y)
                        differ = np.flatnonzero(a[x : x + left] != b[y : y + left])
                    if len(differ):
                        out[at] = x + differ[0]
                        break
                    x, y, size = x + size, y + size, min(size * 4, 1 << 16)
            break
        places = out[live]
        same = a[places[:, None] + STEPS] == b[(j[live] + places - i[live])[:, None] + STEPS]
        whole = same.all(axis=1)
        out[live] += np.where(whole, WINDOW, same.argmin(axis=1))
        live = live[whole]
    return out


def reached(a: np.ndarray, b: np.ndarray, most: int, keep: bool) -> tuple[int, list[np.ndarray]] | None:
    """The number of edits, and for each number below it how far each diagonal is reached with it (if ``keep``): the element
    ``k + e`` of the row for ``e`` edits is the last place in ``a`` with that distance at most on diagonal ``k``. None where
    more than ``most`` edits are needed, or where it looks like that early on."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    a, b = np.append(a, np.full(WINDOW, 0xFFFFFFFF, np.uint32)), np.append(b, np.full(WINDOW, 0xFFFFFFFE, np.uint32))
    rows: list[np.ndarray] = []
    row = np.zeros(0, np.int64)
    for e in range(most + 1):
        k = np.arange(-e, e + 1)
        start = np.full(2 * e + 1, NOWHERE if e else 0, np.int64)
        if e:
            start[:-2] = row
            start[1:-1] = np.maximum(start[1:-1], row + 1)
            start[2:] = np.maximum(start[2:], row + 1)
        start = np.minimum(start, np.minimum(n, m + k))
        inside = start >= np.maximum(k, 0)
        row = np.where(inside, start, NOWHERE)
        row[inside] = _slide(a, b, start[inside], (start - k)[inside])
        if abs(n - m) <= e and row[n - m + e] >= n:
            return e, rows
        if e >= 8 and not e & (e - 1) and e * n > 4 * most * max(1, int(row.max())):
            return None  # at this pace the edits come to far more than are followed
        if keep:
            rows.append(row.astype(np.int32))
    return None


def distance(ref: str | list, hyp: str | list) -> int:
    """Levenshtein distance of two texts or lists."""
    a, b = codes(ref, hyp)
    start, end = ends(a, b)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    if _within(a, b) is not None:
        return len(a) - len(b)
    near = reached(a, b, _most_edits(len(a), len(b), False), False)
    return _by_vectors(a, b) if near is None else near[0]


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The places in ``a`` of the elements of ``b``, in order and as late as can be; None where ``b`` isn't in ``a`` like that."""
    if len(a) <= len(b) or int(max(a.max(), b.max(initial=0))) > 0x10FFFF:
        return None
    text, other = (x.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for x in (a, b))
    out, at, find = np.empty(len(b), np.int64), len(a), text.rfind
    for j in range(len(b) - 1, -1, -1):
        at = find(other[j], 0, at)
        if at < j:
            return None
        out[j] = at
    return out


def _most_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A distance that isn't exceeded, for ``a`` at least as long: element by element, from the start or the end."""
    n, m = len(a), len(b)
    return n - m + min(int((a[:m] != b).sum()), int((a[n - m :] != b).sum()))


#: parts of columns for each of which the rows within the band are taken
BANDS = 16


def _by_vectors(a: np.ndarray, b: np.ndarray) -> int:
    """An alignment strays from the shortest way by no more than half of what the distance may exceed the difference in length,
    so only rows of that band are worked on; beyond it, distances count as if they rose by one."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not m:
        return n
    stray = (_most_distance(a, b) - (n - m)) // 2
    step = m if 2 * stray + n - m >= n // 2 else max(64, -(-m // BANDS))
    up = down = low = high = top = 0
    for first in range(0, m, step):
        last = min(first + step, m)
        start, end = (0, n) if step == m else (max(0, first - stray - 1), min(n, last + n - m + stray))
        passed = (1 << (start - low)) - 1
        top += (up & passed).bit_count() - (down & passed).bit_count()
        up, down = (up >> (start - low)) | (((1 << (end - high)) - 1) << (high - start)), down >> (start - low)
        low, high, places, every = start, end, Places(a[start:end]), (1 << (end - start)) - 1
        for x in b[first:last].tolist():
            same = places[x] | down
            flat = ((((same & up) + up) ^ up) | same) & every
            right = ((down | (every ^ (flat | up))) << 1 | 1) & every
            up, down = ((up & flat) << 1 & every) | (every ^ (flat | right)), right & flat
        top += last - first
    return top + up.bit_count() - down.bit_count()


def _equal_before(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many elements before places i and j are equal."""
    done, size = 0, 16
    while True:
        size = min(size, i - done, j - done)
        if not size:
            return done
        differ = np.flatnonzero(a[i - done - size : i - done] != b[j - done - size : j - done])
        if len(differ):
            return done + size - 1 - int(differ[-1])
        done, size = done + size, size * 4


def _back_by_diagonals(a: np.ndarray, b: np.ndarray, edits: int, rows: list[np.ndarray]) -> np.ndarray:
    """The steps that ``_back`` gives, from how far diagonals are reached: a step is possible where the place before it is
    reached with one edit less."""
    i, j, e, out, counts = len(a), len(b), edits, [], []

    def step(op: int, n: int) -> None:
        out.append(op)
        counts.append(n)

    while i or j:
        same = _equal_before(a, b, i, j)
        if same:
            step(EQUAL, same)
            i, j = i - same, j - same
        if not i or not j:
            step(DELETE if i else INSERT, i + j)
            break
        e -= 1
        k, row = i - j, rows[e]
        at = lambda d, e=e, row=row: row[d + e] if -e <= d <= e else NOWHERE
        if at(k) >= i - 1:
            step(SUBSTITUTE, 1)
            i, j = i - 1, j - 1
        elif at(k - 1) >= i - 1:
            step(DELETE, 1)
            i -= 1
        else:
            step(INSERT, 1)
            j -= 1
    return np.repeat(np.array(out, np.uint8), counts)


def _steps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The steps of an alignment from its end, by whichever way is shorter."""
    if not len(a) or not len(b):
        return np.full(len(a) + len(b), DELETE if len(a) else INSERT, np.uint8)
    long, short, op = (a, b, DELETE) if len(a) > len(b) else (b, a, INSERT)
    places = _within(long, short)
    if places is not None:  # nothing but deletions or insertions
        out = np.full(len(long), op, np.uint8)
        out[len(long) - 1 - places] = EQUAL
        return out
    near = reached(a, b, _most_edits(len(a), len(b), True), True)
    if near is not None:
        return _back_by_diagonals(a, b, *near)
    out = _back_nearby(a, b)
    return np.frombuffer(bytes(_back(a, b) if out is None else out), np.uint8)


#: rows on either side of the diagonal whose bits are kept for the way back; difference in length up to which that is tried
BESIDE, APART = 64, 32


def _back_nearby(a: np.ndarray, b: np.ndarray) -> bytearray | None:
    """What ``_back`` gives, where the way stays near the diagonal; None where it doesn't.

    All optimal ways lie in the band of rows that the largest possible distance allows, so only these are worked on, once, and
    of each column only the bits beside the diagonal are kept. A step that is possible in the table is possible in the band.
    """
    n, m = len(a), len(b)
    if abs(n - m) > APART:
        return None
    most = _most_distance(a, b) if n >= m else _most_distance(b, a)
    below, above = (most - n + m) // 2, (most + n - m) // 2
    step = m if below + above >= n // 2 else max(256, -(-m // (2 * BANDS)))
    up = down = low = high = 0
    window, kept, xs, ys, whole = (1 << 2 * BESIDE) - 1, [], a.tolist(), b.tolist(), Places(a)
    for first in range(0, m, step):
        last = min(first + step, m)
        start, end = (0, n) if step == m else (max(0, first - below - 1), min(n, last + above))
        up, down = (up >> (start - low)) | (((1 << (end - high)) - 1) << (high - start)), down >> (start - low)
        low, high, every = start, end, (1 << (end - start)) - 1
        shift, places = first - BESIDE - start, {y: (whole[y] >> start) & every for y in set(ys[first:last])}
        for y in ys[first:last]:
            same = places[y] | down
            flat = ((((same & up) + up) ^ up) | same) & every
            right = ((down | (every ^ (flat | up))) << 1 | 1) & every
            up, down = ((up & flat) << 1) | (every ^ (flat | right)), right & flat
            kept.append(((flat >> shift) & window, (up >> shift) & window) if shift >= 0 else ((flat << -shift) & window, (up << -shift) & window))
            shift += 1
        up &= every
    out, i, j = bytearray(), n, m
    while i and j:
        if xs[i - 1] == ys[j - 1]:
            out.append(EQUAL)
            i, j = i - 1, j - 1
            continue
        place = i - j + BESIDE
        if not 0 <= place < 2 * BESIDE:
            return None
        flat, up = kept[j - 1]
        if not flat >> place & 1:
            out.append(SUBSTITUTE)
            i, j = i - 1, j - 1
        elif up >> place & 1:
            out.append(DELETE)
            i -= 1
        else:
            out.append(INSERT)
            j -= 1
    return out + bytes([DELETE if i else INSERT]) * (i + j)


def _back(a: np.ndarray, b: np.ndarray) -> bytearray:
    """The steps of an optimal alignment from its end. The diagonal goes first, then deletion, then insertion."""
    n, m = len(a), len(b)
    every, size, places = (1 << n) - 1, n // 8 + 1, Places(a)
    width = max(1, m if 2 * size * m <= KEPT_BYTES else int(m**0.5))
    kept, up, down, xs, ys = [], every, 0, a.tolist(), b.tolist()
    out, i, j = bytearray(), n, m

    def columns(first: int, last: int, up: int, down: int, keep: bool) -> tuple[int, int, list[tuple[bytes, bytes]]]:
        held = []
        for y in ys[first:last]:
            same = places[y] | down
            flat = ((((same & up) + up) ^ up) | same) & every
            right = ((down | (every ^ (flat | up))) << 1 | 1) & every
            up, down = ((up & flat) << 1 & every) | (every ^ (flat | right)), right & flat
            if keep:
                held.append((flat.to_bytes(size, "little"), up.to_bytes(size, "little")))
        return up, down, held

    if width < m:
        for first in range(0, m, width):
            kept.append((up, down))
            up, down, _ = columns(first, min(first + width, m), up, down, False)
    else:
        kept.append((up, down))
    for first in range((m - 1) // width * width, -1, -width):
        held = columns(first, min(first + width, m), *kept[first // width], True)[2]
        while j > first:
            if not i:
                out.append(INSERT)
                j -= 1
            elif xs[i - 1] == ys[j - 1]:
                out.append(EQUAL)
                i, j = i - 1, j - 1
            else:
                flat, up_bits = held[j - 1 - first]
                place, bit = (i - 1) >> 3, 1 << ((i - 1) & 7)
                if not flat[place] & bit:
                    out.append(SUBSTITUTE)
                    i, j = i - 1, j - 1
                elif up_bits[place] & bit:
                    out.append(DELETE)
                    i -= 1
                else:
                    out.append(INSERT)
                    j -= 1
    out += bytes([DELETE]) * i
    return out


def align(ref: str | list, hyp: str | list) -> np.ndarray:
    """Chunks ``op, rs, re, hs, he`` of an optimal alignment, half open, in order. What is equal at both ends stays; of equal
    ways between, seen from the end, the diagonal goes first, then deletion, then insertion."""
    a, b = codes(ref, hyp)
    start, end = ends(a, b)
    middle = _steps(a[start : len(a) - end], b[start : len(b) - end])
    ops = np.concatenate([np.zeros(start, np.uint8), middle[::-1], np.zeros(end, np.uint8)])
    cuts = np.flatnonzero(np.diff(ops, prepend=9)) if len(ops) else np.zeros(0, np.int64)
    rows, columns = (np.concatenate([[0], np.cumsum(ops != skip)]) for skip in (INSERT, DELETE))
    bounds = np.append(cuts, len(ops))
    return np.stack([ops[cuts].astype(np.int64), rows[bounds[:-1]], rows[bounds[1:]], columns[bounds[:-1]], columns[bounds[1:]]], 1)


#: cells of a table, and those of its codes' places, up to which pairs are worked on side by side; cells beyond which diagonals go first
MOST_CELLS, MOST_PLACES, FEW_CELLS = 1 << 24, 1 << 25, 1 << 22


def distances(refs: list, hyps: list) -> list[int | None]:
    """Levenshtein distances of texts or lists, pairs of moderate size side by side."""
    out: list[int | None] = []
    wait: list[tuple[int, np.ndarray, np.ndarray]] = []
    for r, h in zip(refs, hyps, strict=True):
        if r is None or h is None:
            out.append(None)
            continue
        a, b = codes(r, h)
        start, end = ends(a, b)
        a, b = a[start : len(a) - end], b[start : len(b) - end]
        if len(a) < len(b):
            a, b = b, a
        if not len(b):
            out.append(len(a))
            continue
        if _within(a, b) is not None:
            out.append(len(a) - len(b))
            continue
        near = None
        most = 32 if FEW_CELLS < len(a) * len(b) <= MOST_CELLS else _most_edits(len(a), len(b), False)
        if len(a) * len(b) > FEW_CELLS:
            near = reached(a, b, most, False)
        if near is not None:
            out.append(near[0])
        elif len(a) * len(b) > MOST_CELLS or (len(np.unique(a)) + len(np.unique(b)) + 1) * (len(a) + 64) > MOST_PLACES:
            out.append(_by_vectors(a, b))
        else:
            wait.append((len(out), a, b))
            out.append(None)
    for (k, _, _), d in zip(wait, side_by_side.distances([p[1:] for p in wait]), strict=True):
        out[k] = d
    return out


def _distances(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for refs, hyps in batches:
        if pa.types.is_list(refs.type):
            for r, h in _slices([(refs, hyps)], True, WORDS_SHARED):
                yield pa.array(distances(*_numbers(r, h)), pa.int32())
        else:
            for r, h in _pieces([(refs, hyps)], False, SHARED):
                yield pa.array(distances(r, h), pa.int32())


def _numbers(refs: pa.ListArray, hyps: pa.ListArray) -> list[list[np.ndarray | None]]:
    """Lists of words as numbers, equal where words are: no word becomes an object of its own."""
    sizes = [pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (refs, hyps)]
    every = pa.concat_arrays([refs.flatten(), hyps.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.uint32)
    out, first = [], 0
    for column, size in zip((refs, hyps), sizes, strict=True):
        there, ends_at = column.is_valid().to_pylist(), (first + np.cumsum(size)).tolist()
        out.append([every[end - n : end] if ok else None for ok, n, end in zip(there, size.tolist(), ends_at, strict=True)])
        first += int(size.sum())
    return out


def _spaced(texts: pa.StringArray) -> pa.ListArray:
    """The words of texts between single spaces, without empty ones."""
    split = pc.split_pattern(texts, " ")
    words = split.flatten()
    there = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))]).astype(np.int32)
    sizes = pc.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(before[np.concatenate([[0], np.cumsum(sizes)])], pa.int32())
    out = pa.ListArray.from_arrays(offsets, words.filter(there))
    return out if not texts.null_count else pc.if_else(texts.is_valid(), out, pa.scalar(None, out.type))


def _text_word_distances(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for r, h in _slices(batches, False, WORDS_SHARED):
        yield pa.array(distances(*_numbers(_spaced(r), _spaced(h))), pa.int32())


def _gaps(refs: list, hyps: list, around: int, words: bool, equal: bool) -> pa.Array:
    numbers = []
    for r, h in zip(refs, hyps, strict=True):
        chunks = align(r, h)
        numbers.append(chunks if equal else chunks[chunks[:, 0] != EQUAL])
    every = np.concatenate(numbers) if numbers else np.zeros((0, 5), np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in numbers], dtype=np.int64)])
    texts = (_joined_words if words else _cut_texts)(refs, hyps, around, every, offsets)
    columns = [pa.array(NAMES[every[:, 0]], pa.string()), *(pa.array(every[:, k], pa.int32()) for k in range(1, 5)), *texts]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=["op", "rs", "re", "hs", "he", "ref", "hyp", "before", "after"]))


def _joined_words(refs: list, hyps: list, around: int, every: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """What chunks of words that aren't equal change, and the words around."""
    texts: list[list] = [[], [], [], []]
    for r, h, first, last in zip(refs, hyps, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for op, rs, re, hs, he in every[first:last].tolist():
            row = (None,) * 4 if op == EQUAL else tuple(map(" ".join, (r[rs:re], h[hs:he], r[max(0, rs - around) : rs], r[re : re + around])))
            for column, text in zip(texts, row, strict=True):
                column.append(text)
    return [pa.array(t, pa.string()) for t in texts]


def _cut_texts(refs: list, hyps: list, around: int, every: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """The same of characters, cut from the bytes of all texts together; none of the chunks is equal."""
    sizes = np.diff(offsets)

    def cutter(texts: list):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        ends_at = np.cumsum([len(t) for t in texts], dtype=np.int64)
        last = np.repeat(ends_at, sizes)
        first = last - np.repeat(np.diff(ends_at, prepend=0), sizes)
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)])

        def cut(low: np.ndarray, high: np.ndarray) -> pa.Array:
            start, n = at[np.maximum(first + low, first)], at[np.minimum(first + high, last)]
            n = n - start
            places = np.concatenate([[0], np.cumsum(n)])
            taken = data[np.repeat(start - places[:-1], n) + np.arange(places[-1])]
            return pa.StringArray.from_buffers(len(n), pa.py_buffer(places.astype(np.int32)), pa.py_buffer(taken))

        return cut

    of_ref, of_hyp = cutter(refs), cutter(hyps)
    rs, re, hs, he = every[:, 1:].T
    return [of_ref(rs, re), of_hyp(hs, he), of_ref(rs - around, rs), of_ref(re, re + around)]


#: characters or words of both sides after which rows are given back: a batch of rows may have gigabytes of chunks
GIVEN = 1 << 18
#: the same for distances, which give one number, of texts and of words
SHARED, WORDS_SHARED = 1 << 23, 1 << 22


def _pieces(batches: Iterable[tuple[pa.Array, pa.Array]], words: bool, given: int = GIVEN) -> Iterator[tuple[list, list]]:
    """The rows of ``_slices`` as lists."""
    for refs, hyps in _slices(batches, words, given):
        yield refs.to_pylist(), hyps.to_pylist()


def _slices(batches: Iterable[tuple[pa.Array, pa.Array]], words: bool, given: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows of both columns in runs of bounded size; of a long text alone."""
    for refs, hyps in batches:
        sizes = [np.asarray((pc.list_value_length if words else pc.utf8_length)(c).fill_null(0).to_numpy(zero_copy_only=False)) for c in (refs, hyps)]
        parts = ((np.cumsum(sizes[0] + sizes[1].astype(np.int64)) - 1) // given).tolist()
        first = 0
        for at in range(1, len(parts) + 1):
            if at == len(parts) or parts[at] != parts[first]:
                yield refs.slice(first, at - first), hyps.slice(first, at - first)
                first = at


#: characters of the reference that a chunk has before and after it
AROUND = 8
OPS = "array<struct<op:string,rs:int,re:int,hs:int,he:int,ref:string,hyp:string,before:string,after:string>>"


def _char_chunks(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for refs, hyps in _pieces(batches, False):
        yield _gaps(refs, hyps, AROUND, False, False)


def _word_chunks(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for refs, hyps in _pieces(batches, True):
        yield _gaps(refs, hyps, 0, True, True)


_made: dict = {}


def _udf(fn, returns: str, kind: ArrowUDFType = ArrowUDFType.SCALAR):
    if fn not in _made:
        _made[fn] = F.arrow_udf(fn, returns, kind)
    return _made[fn]


def char_distance(reference: Column, prediction: Column) -> Column:
    """Edit distance of two texts; null if one is. An Arrow UDF: the built-in one works cell by cell, which whole texts make slow."""
    return _udf(_distances, "int", ArrowUDFType.SCALAR_ITER)(reference, prediction)


def word_levenshtein(reference: Column, prediction: Column) -> Column:
    """Edit distance of two arrays of words."""
    return _udf(_distances, "int", ArrowUDFType.SCALAR_ITER)(reference, prediction)


def word_distance(reference: Column, prediction: Column) -> Column:
    """Edit distance of the words of two texts between single spaces; the texts go to Python as they are, not their words."""
    return _udf(_text_word_distances, "int", ArrowUDFType.SCALAR_ITER)(reference, prediction)


def char_edits(reference: Column, prediction: Column) -> Column:
    """The chunks of two texts' alignment that aren't equal, with what they change and what stands around."""
    return _udf(_char_chunks, OPS, ArrowUDFType.SCALAR_ITER)(reference, prediction)


def word_chunks(reference: Column, prediction: Column) -> Column:
    """All chunks of the alignment of two arrays of words, with the words of those that aren't equal."""
    return _udf(_word_chunks, OPS, ArrowUDFType.SCALAR_ITER)(reference, prediction)
