"""Shortest-pack-first packing of documents that may be cut: sequences without padding, and few cuts.

Documents are cut where they exceed the capacity. The lengths that result are packed by their histogram, longest first,
each into the pack that is shortest so far, and a new pack is opened only where none has room. Packs of one pattern are
runs of numbers, so a plan is as large as there are lengths and patterns, whatever the number of documents. A piece finds
its pack by its rank among pieces of its length, and its place from the pattern.

What packs have left is filled exactly: a share of the pieces is held back, by hash, and cut at the ends of the rooms.
Those are pieces that fill a sequence of their own where there are enough of them (they come from documents that were cut
anyway), else pieces of all lengths. What is left of them makes full sequences, and the last few tokens sequences of a power
of two each, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.base import map_arrow, pick, text_of
from palimpsest.llm.huffman import ids_of
from palimpsest.llm.packing import CAPACITY, MOST_BUCKETS, ROWS_A_BUCKET, ranked
from palimpsest.llm.wordids import word_ids
from palimpsest.session import stash

#: a level is held by half of the pieces of the level two below it; so many levels
LEVELS = 48
#: ranks of a length are below this
MOST_RANKS = 1 << 48


def levels(row_ids: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """From 0 to LEVELS - 1 by a hash of a piece's name: level c or above has about 2 ** (-c / 2) of all pieces."""
    with np.errstate(over="ignore"):
        h = row_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pieces.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    share = ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return np.minimum(np.floor(-2 * np.log2(share)), LEVELS - 1).astype(np.int32)


class ShortestFirst:
    """Packs for a histogram of lengths.

    A run is packs with numbers in a row and the same room. A flow ``(length, first rank, first pack, how many, offset)``
    puts that many pieces of a length, by rank, into that many packs in a row, one each, at one offset.
    """

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.capacity, self.packs = capacity, 0
        self.flows: list[tuple[int, int, int, int, int]] = []
        rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        top = 0
        for n in np.flatnonzero(counts)[::-1].tolist():
            left, done = int(counts[n]), 0
            while top and not rooms[top]:
                top -= 1
            for room in range(top, n - 1, -1):  # what gets a piece comes up again further down
                if not left:
                    break
                runs, rooms[room] = rooms[room], []
                for at, (first, many) in enumerate(runs):
                    if not left:
                        rooms[room] += runs[at:]
                        break
                    taken = min(many, left)
                    self.flows.append((n, done, first, taken, capacity - room))
                    done, left = done + taken, left - taken
                    self._add(rooms[room - n], first, taken)
                    if taken < many:
                        rooms[room].append((first + taken, many - taken))
            if left:
                each = capacity // n
                opened = -(-left // each)
                last = left - (opened - 1) * each
                for k in range(min(each, left)):
                    many = opened if k < last else opened - 1
                    if many:
                        self.flows.append((n, done, self.packs, many, k * n))
                        done += many
                self._add(rooms[capacity - each * n], self.packs, opened if last == each else opened - 1)
                if last < each:
                    self._add(rooms[capacity - last * n], self.packs + opened - 1, 1)
                self.packs += opened
                top = max(top, capacity - last * n, capacity - each * n)
        #: runs with room left: (room, first pack, how many), the largest rooms first
        self.rooms = [(room, first, many) for room in range(capacity, 0, -1) for first, many in rooms[room]]
        self.room = sum(room * many for room, _, many in self.rooms)

    @staticmethod
    def _add(runs: list[tuple[int, int]], first: int, many: int) -> None:
        if not many:
            return
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1] = (runs[-1][0], runs[-1][1] + many)
        else:
            runs.append((first, many))


class FreePlan:
    """Which pieces are held back, and the place of every piece.

    ``counts[n, c]``: pieces of length n and level c. Held back are those of at least ``least`` tokens and ``level``.
    """

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        tokens = np.arange(capacity + 1) @ counts
        every = counts.sum(axis=1)
        need = ShortestFirst(every, capacity).room
        self.least, self.level = capacity, LEVELS
        whole = np.cumsum(counts[capacity][::-1])[::-1] * capacity
        enough = np.flatnonzero(np.append(whole, 0) >= need)
        if need and whole[0] < need:  # too few pieces are full: hold back some of all lengths
            self.least = 1
            upward = np.cumsum(tokens[::-1])[::-1]
            fits = (c for c in range(LEVELS - 1, 0, -1) if upward[c] >= need / 2 and upward[c] >= ShortestFirst(every - counts[:, c:].sum(axis=1), capacity).room)
            self.level = next(fits, 0)
        elif need:
            self.level = int(enough[-1])
        self.held = np.where(np.arange(capacity + 1) >= self.least, counts[:, self.level :].sum(axis=1), 0)
        packs = ShortestFirst(every - self.held, capacity)
        flows = np.array(sorted(packs.flows), np.int64).reshape(-1, 5)
        self.keys = flows[:, 0] * MOST_RANKS + flows[:, 1]
        self.flows = flows
        #: where a length's pieces begin in the stream of what is held back, the longest first
        per_length = self.held * np.arange(capacity + 1)
        self.begins = np.cumsum(per_length[::-1])[::-1] - per_length
        #: what the stream runs through: (start, size, first sequence, offset of its first token), each as often as fits
        self.slots: list[tuple[int, int, int, int]] = []
        at, left = 0, int(per_length.sum())
        for room, first, many in packs.rooms:
            self.slots.append((at, room, first, capacity - room))
            at, left = at + room * many, left - room * many
        self.sequences = packs.packs
        if left >= capacity:
            full = left // capacity
            self.slots.append((at, capacity, self.sequences, 0))
            at, left, self.sequences = at + full * capacity, left - full * capacity, self.sequences + full
        while left:
            size = 1 << (left.bit_length() - 1)
            self.slots.append((at, size, self.sequences, 0))
            at, left, self.sequences = at + size, left - size, self.sequences + 1
        self.starts = [s[0] for s in self.slots]

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces that stay whole, by their ranks (from 0) among those of their length."""
        flow = self.flows[np.searchsorted(self.keys, lengths * MOST_RANKS + ranks, side="right") - 1]
        return flow[:, 2] + ranks - flow[:, 1], flow[:, 4]

    def cut(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """``(start in the piece, length, sequence, offset)`` of what a piece that was held back is cut into."""
        at = int(self.begins[length]) + rank * length
        begin, end, out = at, at + length, []
        while at < end:
            start, size, first, offset = self.slots[bisect_right(self.starts, at) - 1]
            nth, inside = divmod(at - start, size)
            taken = min(end - at, size - inside)
            out.append((at - begin, taken, first + nth, offset + inside))
            at += taken
        return out


PIECES = "doc_id long, row_id long, piece int, start long, length long, doc_tokens long, ids_crc32 long, level int, ids binary"
OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def chunks(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, plain: str) -> DataFrame:
    """Each document's ids with ``end_id`` behind, cut only where longer than ``capacity``, with the ids themselves."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = [c.strip().split()[0] for c in PIECES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            ids, lens = encoder.encode(batch.column(1))
            out: list[tuple] = []
            at = 0
            for doc_id, row_id, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), lens.tolist(), strict=True):
                data = ids[at : at + n].astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                short = np.append(ids[at : at + n], end_id).astype(plain)
                at += n
                for piece, start in enumerate(range(0, n + 1, capacity)):
                    cut = data[4 * start : 4 * (start + capacity)]
                    out.append((doc_id, row_id, piece, start, len(cut) // 4, n + 1, zlib.crc32(cut), 0, short[start : start + capacity].tobytes()))
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * len(names)
            columns[7] = levels(np.array(columns[1], np.int64), np.array(columns[2], np.int64))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    named = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"), F.monotonically_increasing_id().alias("row_id"))
    return map_arrow(named, run, PIECES)


def pack_freely(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    All sequences are full but at most one for each bit of ``capacity``, each of a power of two. A null or empty text is its
    end id alone. Repeated rows are packed each. Texts are encoded whole however long; columns other than the two, also
    ones with clashing names, are left. An empty table gives no piece. The driver sees how many pieces have each length and
    level, at most ``LEVELS`` numbers for each length.
    """
    plain = "<u2" if max(ids_of(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    items = stash(chunks(docs, tokenizer, capacity, end_id, plain), "pieces")
    counts = np.zeros((capacity + 1, LEVELS), np.int64)
    for row in items.groupBy("length", "level").agg(F.count("*").alias("n")).collect():  # see the docstring
        counts[row["length"], row["level"]] = row["n"]
    plan = FreePlan(counts, capacity)
    back = (F.col("length") >= plan.least) & (F.col("level") >= plan.level)
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    name = F.struct("row_id", "piece")

    def buckets(n: int) -> int:
        return min(MOST_BUCKETS, max(1, -(-n // ROWS_A_BUCKET)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.record_batch([*(batch[c] for c in OUT[:5]), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=OUT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, start, length, doc_tokens, rank, raw in zip(*(batch[c].to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "rank", "ids")), strict=True):
                data = np.frombuffer(raw, plain).astype("<u4").tobytes()
                rows += [(doc_id, start + s, n, zlib.crc32(data[4 * s : 4 * (s + n)]), doc_tokens, q, o) for s, n, q, o in plan.cut(length, rank)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=OUT)

    held = ["row_id", "piece", "doc_id", "start", "length", "doc_tokens"]
    stay = ranked(items.filter(~back).select(*held, "ids_crc32"), "length", buckets(int(counts.sum())), name, "row_id", "piece")
    split = ranked(items.filter(back).select(*held, "ids"), "length", buckets(int(plan.held.sum())), name, "row_id", "piece")
    return map_arrow(stay.select(*OUT[:5], "rank"), whole, out).unionByName(map_arrow(split.select(*held, "rank", "ids"), cut, out))
