"""Best-fit packing by linear grouping: pieces of documents into as few sequences as it can.

The driver only sees histograms over lengths (at most ``capacity`` rows each), so what it plans has a size that doesn't
depend on the data: which group of large pieces fills which place of which configuration, which of these sequences are taken
apart again for their room, and which small or freed pieces go into sequences with which room left. Pieces find their places by their rank among pieces of the same length, which is counted
in buckets, so no length is ranked by one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.base import map_arrow, pick, text_of
from palimpsest.llm.wordids import word_ids
from palimpsest.session import stash

CAPACITY = 2048
GROUPS = 96
#: rows of a bucket where the buckets are few; beyond MOST_BUCKETS they grow instead, as one task adds up the buckets of a length
ROWS_A_BUCKET, MOST_BUCKETS = 1_000, 65_536


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id, row_id, piece, start, length, ids_crc32``: each document's ids with ``end_id`` behind, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            ids, lens = encoder.encode(batch.column(1))
            out: list[tuple] = []
            at = 0
            for doc_id, row_id, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), lens.tolist(), strict=True):
                data = ids[at : at + n].astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                at += n
                for piece, start in enumerate(range(0, n + 1, capacity)):
                    cut = data[4 * start : 4 * (start + capacity)]
                    out.append((doc_id, row_id, piece, start, len(cut) // 4, zlib.crc32(cut)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, PIECE_TYPES, strict=True)], names=PIECE_NAMES)

    named = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"), F.monotonically_increasing_id().alias("row_id"))
    return map_arrow(named, run, "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long")


PIECE_NAMES = ["doc_id", "row_id", "piece", "start", "length", "ids_crc32"]
PIECE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def ranked(df: DataFrame, key: str, buckets: int, spread: Column, *order: str) -> DataFrame:
    """Adds ``rank`` (from 0) among rows of the same ``key``; the rows of a key are ranked in ``buckets`` parts."""
    df = df.withColumn("bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    sums = df.groupBy(key, "bucket").agg(F.count("*").alias("held"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    within = df.withColumn("within", F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)) - 1)
    return within.join(sums, [key, "bucket"]).withColumn("rank", F.col("before") + F.col("within")).drop("bucket", "before", "within")


def fullest(sizes: list[int], values: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is taken in the sequence of the largest value (sizes may repeat)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for g, (size, value) in enumerate(zip(sizes, values.tolist(), strict=True)):
        if value <= 1e-9:
            continue
        for _ in range(capacity // size):  # once more of the same size each time
            new = best[: capacity + 1 - size] + value
            better = np.flatnonzero(new > best[size:] + 1e-12)
            if not len(better):
                break
            best[better + size] = new[better]
            last[better + size] = g
    out, at = np.zeros(len(sizes)), int(np.argmax(best))
    while last[at] >= 0:
        out[last[at]] += 1
        at -= sizes[last[at]]
    return out


#: share of sequences that the linear program may need beyond its least
NEAR = 2e-4


def optimised(sizes: list[int], wanted: list[int], capacity: int, rounds: int = 4_000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in the least total that holds ``wanted`` pieces of each size: a linear
    program by column generation, where the next configuration is the fullest one at the prices so far."""
    m = len(sizes)
    if not m:
        return []
    columns = np.diag([float(capacity // s) for s in sizes])
    inverse, cost, x = np.linalg.inv(columns), np.ones(m), np.array(wanted, float) / np.diag(columns)
    for _ in range(rounds):
        prices = cost @ inverse
        g = int(np.argmin(prices))
        if prices[g] < -1e-9:  # more of this size than wanted costs nothing
            column, price = -np.eye(m)[g], 0.0
        else:
            column, price = fullest(sizes, prices, capacity), 1.0
            if prices @ column <= 1 + NEAR:  # the total is within this share of the least
                break
        along = inverse @ column
        ratios = np.where(along > 1e-9, x / np.where(along > 1e-9, along, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        step = max(0.0, float(ratios[out]))
        x = x - step * along
        x[out] = step
        inverse[out] /= along[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(along[others], inverse[out])
        columns[:, out], cost[out] = column, price
    return [(columns[:, k], float(x[k])) for k in range(m) if cost[k] and x[k] >= 1]


class Plan:
    """Places for large pieces: linear grouping, then the best configurations of the few rounded sizes, as often as whole
    numbers allow; what is left over gets configurations one after the other."""

    def __init__(self, counts: np.ndarray, capacity: int, groups: int = GROUPS) -> None:
        """``counts[n]``: pieces of length n, all of them large."""
        self.capacity = capacity
        total = int(counts.sum())
        lengths = np.flatnonzero(counts)[::-1]  # from the longest
        #: rank of the first piece of each length, in descending order of length
        self.first = np.zeros(capacity + 1, np.int64)
        self.first[lengths] = np.cumsum(counts[lengths]) - counts[lengths]
        ends = np.cumsum(counts[lengths])
        cuts = np.unique(np.linspace(0, total, min(groups, max(1, total)) + 1).astype(np.int64))
        sizes = [int(lengths[np.searchsorted(ends, at, side="right")]) for at in cuts[:-1]]
        self.cuts, self.sizes = cuts, sizes
        left = np.diff(cuts).tolist()
        #: for each group: (slots before, first sequence, pieces of the group in a sequence)
        self.slots: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
        #: sequences of each configuration, and for each of its groups (group, slots before, pieces in a sequence)
        self.configurations: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.lengths, self.ends = lengths, ends
        self.reopen([])
        used, self.sequences = [0] * len(sizes), 0
        def use(config: dict[int, int], most: int) -> None:
            times = min(most, *(left[g] // k for g, k in config.items()))
            if not times:
                return
            self.configurations.append((times, [(g, used[g], k) for g, k in config.items()]))
            for g, k in config.items():
                self.slots[g].append((used[g], self.sequences, k))
                used[g] += k * times
                left[g] -= k * times
            self.sequences += times

        for config, times in optimised(sizes, left, capacity):
            use({int(g): int(config[g]) for g in np.flatnonzero(config)}, int(times + 1e-6))
        #: configurations of the linear program; those of what its whole numbers leave over follow
        self.optimised = len(self.configurations)
        while any(left):
            use(self._configuration(left), 1 << 62)

    def segments(self) -> list[tuple[int, int, int, int]]:
        """``(configuration, from, to, room)``: the turns of a configuration between which its sequences are alike once the
        actual pieces are in, and the room that they have left. Turns change where a length ends, so the work grows with
        lengths and configurations, not with pieces."""
        out = []
        for c, (times, held) in enumerate(self.configurations):
            turns = [np.array([0])]
            for g, before, k in held:
                first = self.cuts[g] + before
                inside = self.ends[np.searchsorted(self.ends, first, side="right") : np.searchsorted(self.ends, first + k * times)] - first
                turns += [inside // k, inside // k + 1]
            at = np.unique(np.concatenate(turns))
            at = at[at < times]
            total = np.zeros(len(at), np.int64)
            for g, before, k in held:
                ranks = self.cuts[g] + before + at[:, None] * k + np.arange(k)
                total += self.lengths[np.searchsorted(self.ends, ranks, side="right")].sum(axis=1)
            out += [(c, int(x), int(y), int(r)) for x, y, r in zip(at, np.append(at[1:], times), self.capacity - total, strict=True)]
        return out

    def rooms(self) -> np.ndarray:
        """How many sequences have each room left once the actual pieces are in."""
        out = np.zeros(self.capacity + 1, np.int64)
        for _, x, y, room in self.segments():
            out[room] += y - x
        return out

    def reopen(self, segments: list[tuple[int, int, int, int]]) -> None:
        """Take the sequences of these segments apart: their pieces are to be put by best fit."""
        spans = []
        for c, x, y, _ in segments:
            for g, before, k in self.configurations[c][1]:
                first = int(self.cuts[g]) + before
                spans.append((first + x * k, first + y * k))
        spans.sort()
        self.freed = np.array(spans, np.int64).reshape(-1, 2)
        #: freed pieces before each span
        self.freed_before = np.concatenate([[0], np.cumsum(self.freed[:, 1] - self.freed[:, 0])])

    def _freed_until(self, overall: np.ndarray) -> np.ndarray:
        """How many freed pieces have a smaller rank, among pieces of all lengths from the longest on."""
        at = np.searchsorted(self.freed[:, 0], overall, side="right")
        last = self.freed[np.maximum(at - 1, 0)] if len(self.freed) else np.zeros((len(overall), 2), np.int64)
        return np.where(at > 0, self.freed_before[np.maximum(at - 1, 0)] + np.minimum(overall, last[:, 1]) - last[:, 0], 0)

    def pooled(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The rank of each freed piece among the freed ones of its length; -1 for a piece that keeps its place."""
        overall = self.first[lengths] + ranks
        before = self._freed_until(overall)
        return np.where(self._freed_until(overall + 1) > before, before - self._freed_until(self.first[lengths]), -1)

    def freed_counts(self) -> np.ndarray:
        """Freed pieces of each length."""
        out = np.zeros(self.capacity + 1, np.int64)
        starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        out[self.lengths] = self._freed_until(self.ends) - self._freed_until(starts)
        return out

    def _configuration(self, left: list[int]) -> dict[int, int]:
        """The largest size left, and with it the sizes that fill the rest of a sequence best."""
        lead = next(g for g, n in enumerate(left) if n)
        room = self.capacity - self.sizes[lead]
        best = np.full(room + 1, -1, np.int64)  # the group that was added last to reach this fill
        best[0] = -2
        reached = np.zeros(room + 1, bool)
        reached[0] = True
        for g in range(lead, len(left)):
            size, most = self.sizes[g], left[g] - (g == lead)
            if size > room or most <= 0:
                continue
            fresh = reached.copy()
            for k in range(1, min(most, room // size) + 1):
                moved = np.zeros(room + 1, bool)
                moved[k * size :] = reached[: room + 1 - k * size]
                new = moved & ~fresh
                best[new] = g * 64 + min(k, 63) if k < 64 else best[new]
                fresh |= new if k < 64 else False
            reached = fresh
            if reached[room]:
                break
        config, at = {lead: 1}, int(np.flatnonzero(reached)[-1])
        while best[at] >= 0:
            g, k = divmod(int(best[at]), 64)
            config[g] = config.get(g, 0) + k
            at -= k * self.sizes[g]
        return config

    def sequence(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The sequence of each large piece, from its rank among those of its length."""
        overall = self.first[lengths] + ranks
        groups = np.searchsorted(self.cuts, overall, side="right") - 1
        out = np.zeros(len(overall), np.int64)
        for g in np.unique(groups):
            here = groups == g
            within = overall[here] - self.cuts[g]
            before, start, k = (np.array(x, np.int64) for x in zip(*self.slots[g], strict=True))
            at = np.searchsorted(before, within, side="right") - 1
            out[here] = start[at] + (within - before[at]) // k[at]
        return out


class SmallPlan:
    """Best fit of small pieces, longest first, into sequences by the room they have left.

    Sequences that share a room and a history are one run ``(room at first, first rank, how many)``. ``flows[n]`` lists
    ``(first piece, run's room at first, run's first rank, pieces of this length in a sequence)`` for pieces of length n.
    A room at first of -1 means sequences opened here, numbered from 0.
    """

    def __init__(self, counts: np.ndarray, rooms: np.ndarray, capacity: int) -> None:
        state: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for room in np.flatnonzero(rooms).tolist():
            if room:
                state[room].append((room, 0, int(rooms[room])))
        self.flows: dict[int, list[tuple[int, int, int, int]]] = {}
        self.opened = 0
        for n in np.flatnonzero(counts)[::-1].tolist():
            left, done, flows = int(counts[n]), 0, []

            def put(room: int, run: tuple[int, int, int], k: int, many: int, n: int = n, flows: list = flows) -> None:
                nonlocal left, done
                flows.append((done, run[0], run[1], k))
                done, left = done + k * many, left - k * many
                state[room - k * n].append((run[0], run[1], many))

            for room in sorted(r for r, runs in state.items() if r >= n and runs):
                runs, state[room] = state[room], []
                for run in runs:
                    k = room // n
                    many = min(run[2], left // k)
                    if many:
                        put(room, run, k, many)
                        run = (run[0], run[1] + many, run[2] - many)
                    if run[2] and left:  # fewer than k pieces are left: one sequence takes them
                        put(room, run, left, 1)
                        run = (run[0], run[1] + 1, run[2] - 1)
                    if run[2]:
                        state[room].append(run)
                if not left:
                    break
            if left:
                k = capacity // n
                full = left // k
                if full:
                    put(capacity, (-1, self.opened, full), k, full)
                    self.opened += full
                if left:
                    put(capacity, (-1, self.opened, 1), left, 1)
                    self.opened += 1
            self.flows[n] = flows

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each small piece the room at first and the rank of its sequence."""
        rooms, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths):
            here = lengths == n
            first, room, rank, k = (np.array(x, np.int64) for x in zip(*self.flows[int(n)], strict=True))
            flow = np.searchsorted(first, ranks[here], side="right") - 1
            rooms[here], at[here] = room[flow], rank[flow] + (ranks[here] - first[flow]) // k[flow]
        return rooms, at


#: shares of the sequences of large pieces that may be taken apart, those with most room left
REOPENED = (0, 1 / 256, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 11 / 16, 3 / 4, 1)


def planned(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> tuple[int, Plan]:
    """The length up to which pieces are small (an eighth of the capacity unless given), and the plan for those above.

    Rounding leaves sequences of large pieces with a little room each, too little for most small pieces. So those with most
    room are taken apart again, and their pieces are put by best fit with the small ones, into what is left open first. The
    share of the sequences that this is done for is the one that needs the fewest, and of those the one that frees the
    fewest pieces: none, where configurations are better than best fit, and all only where nothing else is as good as it.
    """
    small = capacity // 8 if small is None else small
    is_large = np.arange(capacity + 1) > small
    plan = Plan(np.where(is_large, counts, 0), capacity, groups)
    few = np.where(is_large, 0, counts)
    segments = sorted(plan.segments(), key=lambda s: -s[3])
    all_rooms = plan.rooms()
    best: tuple[int, int, list] | None = None
    for spare in (False, True):  # with what the whole numbers of the linear program leave over, or without
        base = [x for x in segments if spare and x[0] >= plan.optimised]
        others = [x for x in segments if not spare or x[0] < plan.optimised]
        for share in REOPENED:
            left, chosen = int(share * plan.sequences), list(base)
            for c, x, y, room in others:
                if left <= 0:
                    break
                chosen.append((c, x, min(y, x + left), room))
                left -= y - x
            plan.reopen(chosen)
            rooms, freed = all_rooms.copy(), plan.freed_counts()
            for _, x, y, room in chosen:
                rooms[room] -= y - x
            needed = int(rooms.sum()) + SmallPlan(few + freed, rooms, capacity).opened
            if best is None or (needed, int(freed.sum())) < best[:2]:
                best = needed, int(freed.sum()), chosen
    plan.needed = best[0]
    plan.reopen(best[2])
    return small, plan


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``items(row_id, piece, length)``, each of 1 to ``capacity`` ids.

    ``planned`` says which pieces are placed how; small pieces and freed ones are put by one best fit. ``items`` is read several times: pass a written table.
    An empty table gives an empty one; equal rows are ranked by row_id and piece and all placed.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    buckets = min(MOST_BUCKETS, max(1, -(-int(counts.sum()) // ROWS_A_BUCKET)))
    small, plan = planned(counts, capacity, groups, small)
    is_large = np.arange(capacity + 1) > small
    key = F.struct("row_id", "piece")
    with_rank = stash(ranked(items, "length", buckets, key, "row_id", "piece"), "ranks")

    def place_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            stays = plan.pooled(lengths, ranks) < 0
            found = plan.sequence(lengths[stays], ranks[stays])
            yield pa.record_batch([*(batch[c].filter(pa.array(stays)) for c in ("row_id", "piece", "length")), pa.array(found)], names=["row_id", "piece", "length", "sequence_id"])

    cut = ["row_id", "piece", "length", "rank"]
    placed = "row_id long, piece int, length long, sequence_id long"
    large = map_arrow(with_rank.filter(F.col("length") > small).select(*cut), place_large, placed)
    sequences = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    open_sequences = stash(ranked(sequences, "room", buckets, F.col("sequence_id"), "sequence_id"), "rooms")
    rooms = np.zeros(capacity + 1, np.int64)
    for row in open_sequences.groupBy("room").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        rooms[row["room"]] = row["n"]
    rest = SmallPlan(np.where(is_large, 0, counts) + plan.freed_counts(), rooms, capacity)

    def place_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy().copy()
            large = lengths > small
            ranks[large] = plan.pooled(lengths[large], ranks[large])
            mine = ranks >= 0
            room, at = rest.place(lengths[mine], ranks[mine])
            yield pa.record_batch([*(batch[c].filter(pa.array(mine)) for c in ("row_id", "piece", "length")), pa.array(room), pa.array(at)], names=["row_id", "piece", "length", "room", "at"])

    put = map_arrow(with_rank.select(*cut), place_small, "row_id long, piece int, length long, room long, at long")
    old = put.filter("room >= 0").join(open_sequences.select("room", F.col("rank").alias("at"), "sequence_id"), ["room", "at"])
    new = put.filter("room < 0").withColumn("sequence_id", F.col("at") + F.lit(plan.sequences))
    every = large.unionByName(old.select("row_id", "piece", "length", "sequence_id")).unionByName(new.select("row_id", "piece", "length", "sequence_id"))
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "row_id", "piece").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("offset", F.sum("length").over(in_sequence) - F.col("length")).select("row_id", "piece", "sequence_id", "offset")
    return items.join(every, ["row_id", "piece"])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is its end id alone. Repeated rows are packed each. Texts are encoded whole however long; columns
    other than the two, also ones with clashing names, are left. An empty table gives no piece.
    """
    items = stash(pieces(docs, tokenizer, capacity), "pieces")
    return pack(items, capacity, groups).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
