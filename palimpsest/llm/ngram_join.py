"""N-gram Jaccard join by partitions of the universe of shingles.

Sets fall into bands by size. A band cuts the universe into segments by hash; two similar sets differ in at most H
shingles, so of H + 1 segments at least one is the same in both. What a set gives for a segment is its signature: a hash of
the part of the set that falls there. Two segments of a band also have the signatures of their part with one shingle left
out; if the sets don't meet there, they differ by at least two in each, so two segments fewer are needed. Which segments
a set gives is a matter of cost: the H + 1 signatures that the fewest sets share, counted over all sets. As all sets rank
signatures alike, similar ones still meet. What no other set has is not sent at all, so most sets without a near copy send
nothing. The smallest band has a segment for each shingle.

Buckets give pairs; those of many sets give the pairs of their smallest member first, and the others are compared in blocks
where they are in different components by then. Every link is verified on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.base import map_arrow, pick, text_of
from palimpsest.llm.components import components
from palimpsest.llm.shingles import mix, shingle_sets
from palimpsest.session import stash

#: sets below SMALLEST are one band; each later band reaches to GROWTH times the last
SMALLEST, GROWTH, SEGMENTS_A_SHINGLE, RICH = 128, 2, 0.35, 2
#: bits of a map of the signatures that several sets share; one that looks shared and isn't does no harm
MAP_BITS = 28
#: from so many sets on a signature's own count matters for cost, and at most so many counts are sent to every task
COUNTED, SENT_COUNTS = 8, 400_000
#: sets in a bucket from which only pairs with its smallest member are tried first
STAR = 6
#: classes in a task's memory of what it has given
REMEMBERED = 300_000
#: rows with a proven number up to this are sent to every task
SENT = 200_000
#: members verified against one copy of a hub's set
MEMBERS = 250
#: sets of one signature that a task holds, about; more are dealt to several tasks, as far as counts were sent
SPLIT = 200_000
#: entries that a task holds, about
ENTRIES = 2_000_000
#: sets in a block of a group whose members are compared with one another, and shingles compared at once
BLOCK, COLUMNS = 256, 4_096
#: bytes of a signature that are counted
KEPT = 6
LOW = np.uint64((1 << 8 * KEPT) - 1)
ONE = np.uint64(1)
BAND, SEGMENT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
NUMERATOR, DENOMINATOR = 80, 100


def band(size: int) -> int:
    k = 0
    while size >= SMALLEST * GROWTH**k:
        k += 1
    return k


def first_size(k: int) -> int:
    return 1 if k == 0 else SMALLEST * GROWTH ** (k - 1)


def most_different(size: int, other: int) -> int:
    """Largest symmetric difference of two linked sets of these sizes: 100 * i >= 80 * u and i + u = size + other."""
    return (size + other) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def roles(size: int) -> list[tuple[int, int]]:
    """``(band, H)`` for each band in which a set of this size meets partners."""
    k = band(size)
    out = [(k, most_different(size, size * DENOMINATOR // NUMERATOR))]
    low = -(-size * NUMERATOR // DENOMINATOR)
    if k and low < first_size(k):
        out.append((k - 1, most_different(size, first_size(k) - 1)))
    return out


def signatures(shingles: np.ndarray, k: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Signatures of the plain segments that hold something, and for each rich one its own and those with one left out."""
    salt = np.uint64((k + 1) * int(BAND) % (1 << 64))
    if k == 0:
        return mix(shingles ^ salt), []
    m = int(np.ceil(SEGMENTS_A_SHINGLE * first_size(k + 1)))
    segment = (mix(shingles + BAND) % np.uint64(m)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, parts = segment[order], mix(shingles[order] ^ SEGMENT)
    starts = np.flatnonzero(np.diff(segment, prepend=-1))
    sums, held = np.add.reduceat(parts, starts), segment[starts]
    marks = held.astype(np.uint64) * SEGMENT + salt
    whole = mix(sums + marks)
    rich = []
    for i in range(int((held < RICH).sum())):
        end = starts[i + 1] if i + 1 < len(starts) else len(parts)
        own = parts[starts[i] : end]
        without = mix(sums[i] - own + marks[i]) if len(own) > 1 else own[:0]
        rich.append((int(whole[i]), without))
    return whole[len(rich) :], rich


def keys_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0]), int(mix(np.array([mix(shingles ^ BAND).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])


class Deal:
    """Entries by the part of the key range they belong to, given out as blobs of bounded size."""

    def __init__(self, parts: int, most: int = 1 << 20) -> None:
        self.parts, self.most, self.held, self.n = parts, most, [], 0

    def add(self, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``entries``: rows of uint64, the first the key."""
        self.held.append(entries)
        self.n += len(entries)
        if self.n >= self.most:
            yield self.flush()

    def part_of(self, rows: np.ndarray) -> np.ndarray:
        return (rows[:, 0] >> np.uint64(40)) % np.uint64(self.parts)

    def packed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries by part, each as bytes."""
        part = self.part_of(rows)
        order = np.argsort(part, kind="stable")
        return part[order], rows[order].view(np.uint8)

    def flush(self) -> pa.RecordBatch:
        rows = np.concatenate(self.held) if self.held else np.zeros((0, 2), np.uint64)
        self.held, self.n = [], 0
        part, raw = self.packed(rows)
        cuts = np.flatnonzero(np.diff(part)) + 1
        blobs = [x.tobytes() for x in np.split(raw, cuts)] if len(part) else []
        firsts = part[np.concatenate([[0], cuts])].astype(np.int32) if len(part) else np.zeros(0, np.int32)
        return pa.record_batch([pa.array(firsts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


class DealCounts(Deal):
    """Signatures with how often they were met, added up before they are sent, so that a frequent one takes a few bytes. A
    part is a range of the map's cells."""

    def packed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = Costs.cells(rows[:, 0])
        keys = np.sort(cells.astype(np.uint64) << np.uint64(8 * KEPT - MAP_BITS) | (rows[:, 0] & LOW) >> np.uint64(MAP_BITS))  # by cell first
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ ONE)) if len(keys) else np.zeros(0, np.int64)
        times, keys = np.diff(np.append(first, len(keys))), keys[first]
        more = -(-times // 255)  # a byte holds 255
        rest = np.full(int(more.sum()), 255, np.uint8)
        rest[np.cumsum(more) - 1] = times - 255 * (more - 1)
        keys = np.repeat(keys, more)
        raw = np.empty((len(keys), KEPT + 1), np.uint8)
        raw[:, :KEPT] = keys.reshape(-1, 1).view(np.uint8)[:, :KEPT]
        raw[:, KEPT] = rest
        part = (keys >> np.uint64(8 * KEPT - MAP_BITS)) * np.uint64(self.parts) >> np.uint64(MAP_BITS)
        return part, raw


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.col("part")).select("blob")


def _entries(batches: Iterator[pa.RecordBatch], width: int, dtype: str = "<u8") -> np.ndarray:
    found = [np.frombuffer(b, dtype) for batch in batches for b in batch.column(0).to_pylist()]
    return (np.concatenate(found) if found else np.zeros(0, dtype)).reshape(-1, width)


class Costs:
    """How many sets share a signature, as far as it matters for cost: a map of what is shared at all, and the largest counts."""

    def __init__(self, shared: np.ndarray, sigs: np.ndarray, counts: np.ndarray) -> None:
        self.shared, self.sigs, self.counts = shared, sigs, counts

    @staticmethod
    def cells(sigs: np.ndarray) -> np.ndarray:
        return ((sigs & LOW) % np.uint64(1 << MAP_BITS)).astype(np.int64)

    def of(self, sigs: np.ndarray) -> np.ndarray:
        cells = self.cells(sigs)
        out = ((self.shared[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).astype(np.int64)
        if len(self.sigs):
            low = sigs & LOW
            at = np.minimum(np.searchsorted(self.sigs, low), len(self.sigs) - 1)
            out = np.where(self.sigs[at] == low, self.counts[at], out)
        return out


def common_signatures(docs: DataFrame, parts: int) -> Costs:
    """Counts the signatures of all sets, by 48 of their bits. What comes to the driver has a bounded size: a map of
    ``2 ** MAP_BITS`` bits, of which each part makes its own range, and ``SENT_COUNTS`` counts. Both only rank signatures,
    so their bounds change no result: where the map is full, sets send signatures that they needn't."""
    parts = min(parts, 1 << 16)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, seen = DealCounts(parts), set()
        for batch in batches:
            for shingles in shingle_sets(batch.column(0)):
                if not len(shingles) or (key := keys_of(shingles)[0]) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(key)
                for k, _ in roles(len(shingles)):
                    plain, rich = signatures(shingles, k)
                    yield from deal.add(np.concatenate([plain, *(np.append(without, np.uint64(whole)) for whole, without in rich)]).reshape(-1, 1))
        yield deal.flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            raw = np.concatenate(held)
            held.clear()
            fresh = np.zeros((len(raw), 8), np.uint8)
            fresh[:, :KEPT] = raw[:, :KEPT]
            every, n = np.concatenate([keys, fresh.reshape(-1).view("<u8")]), np.concatenate([times, raw[:, KEPT]])
            order = np.argsort(every, kind="stable")
            every, n = every[order], n[order]
            first = np.flatnonzero(np.diff(every, prepend=every[:1] ^ ONE))
            return every[first], np.add.reduceat(n, first)

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(np.frombuffer(blob, np.uint8).reshape(-1, KEPT + 1))
            if sum(map(len, held)) > 1 << 21:
                keys, times = added()
        if held:
            keys, times = added()
        shift = np.uint64(8 * KEPT - MAP_BITS)
        cells = np.unique((keys[times > 1] >> shift).astype(np.int64))
        if len(cells):  # this part's range of the map
            low = int(cells[0]) >> 3
            bits = np.zeros((int(cells[-1]) >> 3) - low + 1, np.uint8)
            np.bitwise_or.at(bits, (cells >> 3) - low, (1 << (cells & 7)).astype(np.uint8))
            yield pa.record_batch([pa.array([low]), pa.nulls(1, pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["sig", "n", "cells"])
        many = np.flatnonzero(times >= COUNTED)
        sigs = (keys[many] & ((ONE << shift) - ONE)) << np.uint64(MAP_BITS) | keys[many] >> shift
        yield pa.record_batch([pa.array(sigs.view(np.int64)), pa.array(times[many]), pa.nulls(len(many), pa.binary())], names=["sig", "n", "cells"])

    given = map_arrow(docs.select("text"), give, "part int, blob binary")
    counted = stash(map_arrow(_dealt(given, parts), count, "sig long, n long, cells binary"), "counts")
    shared = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in counted.filter("cells is not null").select("sig", "cells").toLocalIterator():  # ranges that don't overlap but at their ends
        bits = np.frombuffer(bytes(row["cells"]), np.uint8)
        shared[row["sig"] : row["sig"] + len(bits)] |= bits
    rows = counted.filter("cells is null").select("sig", "n").orderBy(F.col("n").desc(), "sig").limit(SENT_COUNTS).toArrow()
    sigs, counts = rows["sig"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(sigs)
    return Costs(shared, sigs[order], counts[order])


def chosen(shingles: np.ndarray, k: int, different: int, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """What a set sends in a band: whole signatures, and those with one shingle left out; only what others share."""
    plain, rich = signatures(shingles, k)
    need, whole, left_out = different + 1, [], []
    for own, without in rich:
        prices = costs.of(np.append(without, np.uint64(own)))
        cheap = prices < COUNTED
        whole.append(np.array([own], np.uint64)[cheap[-1:] & (prices[-1:] > 0)])
        left_out.append(without[cheap[:-1] & (prices[:-1] > 0)])
        if len(without) and cheap.all():
            need -= 2
    prices = costs.of(plain)
    order = np.lexsort((plain, prices))[: max(0, need)]
    whole.append(plain[order[prices[order] > 0]])
    return np.concatenate(whole), np.concatenate([np.zeros(0, np.uint64), *left_out])


class Split(Deal):
    """Signatures and sets, by signature; those of frequent signatures by set too."""

    def __init__(self, parts: int, costs: Costs, split: int) -> None:
        super().__init__(parts)
        self.costs, self.split = costs, split

    def part_of(self, rows: np.ndarray) -> np.ndarray:
        part = super().part_of(rows)
        pieces = self.costs.of(rows[:, 0]) // self.split
        often = pieces > 0
        if often.any():
            part[often] = (part[often] + mix(rows[often, 1] & ~ONE) % (pieces[often].astype(np.uint64) + ONE)) % np.uint64(self.parts)
        return part


def bucket_pairs(docs: DataFrame, parts: int, costs: Costs) -> DataFrame:
    """``a, b, hub``: pairs of set keys to try (hub null), and the members of large buckets (b null) with the bucket's hub,
    its smallest member. Buckets with one hub mostly hold the same group and are taken together. A bucket of very many sets
    is split by set; each piece has its own hub, and the smallest of them is the hub of all."""

    sent = docs.sparkSession.sparkContext.broadcast(costs)  # of bounded size

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, seen = Split(parts, sent.value, SPLIT), set()
        for batch in batches:
            for shingles in shingle_sets(batch.column(0)):
                if not len(shingles) or (key := keys_of(shingles)[0]) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(key)
                even = np.array([key], np.int64).view(np.uint64)[0] & ~ONE
                for k, different in roles(len(shingles)):
                    whole, left_out = chosen(shingles, k, different, sent.value)
                    rows = np.empty((len(whole) + len(left_out), 2), np.uint64)
                    rows[: len(whole), 0], rows[len(whole) :, 0] = whole, left_out
                    rows[: len(whole), 1], rows[len(whole) :, 1] = even, even | ONE
                    yield from deal.add(rows)
        yield deal.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _entries(batches, 2)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[:1, 0] ^ ONE)) if len(rows) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(rows))
        split = sent.value.of(rows[starts, 0]) >= SPLIT if len(rows) else np.zeros(0, bool)
        pairs: list[np.ndarray] = []
        members: list[np.ndarray] = []
        pieces: list[tuple[int, int]] = []
        several = (ends - starts > 1) | split
        for a, b, is_split in zip(starts[several].tolist(), ends[several].tolist(), split[several].tolist(), strict=True):
            keys = np.unique(rows[a:b, 1])
            sets = keys & ~ONE
            if not is_split and (sets[0] == sets[-1] or (keys & ONE).all()):
                continue
            if not is_split and len(keys) < STAR:
                i, j = np.triu_indices(len(keys), 1)
                fine = (sets[i] != sets[j]) & ~((keys[i] & keys[j] & ONE).astype(bool))
                pairs.append(np.stack([sets[i[fine]], sets[j[fine]]], 1))
            else:
                whole = sets[(keys & ONE) == 0]
                hub = whole[0] if len(whole) else sets[0]
                others = np.unique(sets[sets != hub])
                pairs.append(np.stack([np.full(len(others), hub), others], 1))
                members.append(np.stack([np.append(others, hub), np.full(len(others) + 1, hub)], 1))
                if is_split:
                    pieces.append((int(rows[a, 0]), int(hub)))
        found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.uint64)
        found = np.sort(found, axis=1)
        found = np.unique(found, axis=0) if len(found) else found
        held = np.unique(np.concatenate(members), axis=0) if members else np.zeros((0, 2), np.uint64)
        cut = np.array(pieces, np.uint64).reshape(-1, 2)
        for a, b, hub, sig in ((found[:, 0], found[:, 1], None, None), (held[:, 0], None, held[:, 1], None), (None, None, cut[:, 1], cut[:, 0])):
            n = max(len(x) for x in (a, b, hub, sig) if x is not None)
            yield pa.record_batch([pa.nulls(n, pa.int64()) if x is None else pa.array(x.copy().view(np.int64)) for x in (a, b, hub, sig)], names=["a", "b", "hub", "sig"])

    given = map_arrow(docs.select("text"), give, "part int, blob binary")
    found = stash(map_arrow(_dealt(given, parts), meet, "a long, b long, hub long, sig long"), "buckets")
    cut = found.filter("sig is not null").select("hub", "sig")
    if cut.isEmpty():
        return found.drop("sig")
    # pieces of one signature, and with them those of others that have the same hubs, go under one hub
    first = cut.groupBy("sig").agg(F.min("hub").alias("first"))
    linked = stash(components(cut.join(first, "sig").select(F.col("hub").alias("a"), F.col("first").alias("b"))), "hubs")
    named = linked.select(F.col("node").alias("hub"), "component")
    moved = found.filter("sig is null").join(named, "hub", "left").withColumn("hub", F.coalesce("component", "hub")).select("a", "b", "hub")
    return moved.unionByName(linked.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"), F.lit(None).cast("long").alias("hub")))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links ``a, b`` between classes (``cid``) among ``pairs(a, b)`` of set keys, by their whole shingle sets.

    The first of a pair is a hub; members come to it in groups of ``MEMBERS``, so no task gets all members of a hub.
    """
    known = classes.select("cid", F.col("g1").bitwiseAND(F.lit(-2)).alias("key"), "row", "g1", "g2")
    tried = pairs.join(known.select(F.col("key").alias("a"), F.col("cid").alias("ca"), F.col("row").alias("row_a")), "a").join(known.select(F.col("key").alias("b"), F.col("cid").alias("cb"), F.col("row").alias("row_b")), "b")
    tried = stash(tried.select("ca", "row_a", "cb", "row_b").distinct(), "pairs")
    groups = tried.groupBy("ca", "row_a").agg(F.count("*").alias("n")).withColumn("groups", F.ceil(F.col("n") / MEMBERS).cast("int"))
    hubs = groups.select(F.col("row_a").alias("row"), F.col("ca").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(None).cast("long").alias("member"))
    members = tried.join(groups.select("ca", "groups"), "ca").select(
        F.col("row_b").alias("row"), F.col("ca").alias("hub"), F.pmod(F.xxhash64("cb"), F.col("groups")).cast("int").alias("part"), F.col("cb").alias("member")
    )
    sends = stash(hubs.unionByName(members), "sends")
    wanted = stash(sends.groupBy("row").agg(F.collect_list(F.struct("hub", "part", "member")).alias("to")), "wanted")
    small = wanted.count() <= SENT and sends.count() <= 4 * SENT
    texts = docs.join(F.broadcast(wanted) if small else wanted, "row").select("to", "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["hub", "part", "member", "shingles"])

        out, held = [], 0
        for batch in batches:
            for to, shingles in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                raw = shingles.tobytes()
                out += [(t["hub"], t["part"], t["member"], raw) for t in to]
                held += len(raw) * len(to)
                if held >= 1 << 22:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for hub, part, member, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if member is None:  # sorted first in its group
                    at, own = (hub, part), np.frombuffer(raw, np.uint64)
                    continue
                if at != (hub, part):
                    raise ValueError("a hub's own set is missing")
                other = np.frombuffer(raw, np.uint64)
                if NUMERATOR * max(len(own), len(other)) > DENOMINATOR * min(len(own), len(other)):
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                if DENOMINATOR * both >= NUMERATOR * (len(own) + len(other) - both):
                    out.append((hub, member))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    sent = map_arrow(texts, send, "hub long, part int, member long, shingles binary")
    grouped = sent.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("member").asc_nulls_first())
    return stash(map_arrow(grouped, compare, "a long, b long").distinct(), "verified")


def spanning(near: np.ndarray, ids: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """Of all links between ``ids`` and ``others`` so many that what is connected stays connected."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in np.argwhere(near).tolist():
        a, b = find(int(ids[i])), find(int(others[j]))
        if a != b:
            root[b] = a
            out.append((int(ids[i]), int(others[j])))
    return out


def compare_blocks(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """Links between two blocks of ``(cid, component, set)`` in different components, by products of slices of their incidence."""
    sets = [s for _, _, s in [*left, *right]]
    sizes = np.array([len(s) for s in sets])
    _, columns, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    several = held > 1
    place = np.cumsum(several) - 1
    keep = several[columns]
    rows, columns = rows[keep], place[columns[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    n, total = len(left), int(several.sum())
    both = np.zeros((n, len(right)), np.float32)
    for start in range(0, total, COLUMNS):
        a, b = np.searchsorted(columns, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[rows[a:b], columns[a:b] - start] = 1
        both += part[:n] @ part[n:].T
    both = both.astype(np.int64)
    unions = sizes[:n, None] + sizes[None, n:] - both
    apart = np.array([c for _, c, _ in left])[:, None] != np.array([c for _, c, _ in right])[None, :]
    near = apart & (DENOMINATOR * both >= NUMERATOR * unions)
    return spanning(near, np.array([i for i, _, _ in left]), np.array([i for i, _, _ in right]))


def remaining(docs: DataFrame, members: DataFrame, classes: DataFrame, found: DataFrame, first_only: bool = False) -> DataFrame:
    """Links ``a, b`` that large buckets still hold between classes in different components so far; with ``first_only``
    between one class of each component of a bucket alone.

    The members of a hub's buckets are dealt into blocks of ``BLOCK`` sets and every two blocks meet once, so no pair is a
    row and no task gets a whole group.
    """
    known = classes.select("cid", "row", F.col("g1").bitwiseAND(F.lit(-2)).alias("key"))
    grouped = members.select("hub", F.col("a").alias("key")).distinct()
    grouped = grouped.join(known, "key").join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    if first_only:
        grouped = grouped.groupBy("hub", "component").agg(F.min(F.struct("cid", "row")).alias("x")).select("hub", F.col("x.cid").alias("cid"), F.col("x.row").alias("row"), "component")
    grouped = stash(grouped.select("hub", "cid", "row", "component"), "grouped")
    sizes = grouped.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("low <> high").select("hub", "blocks")
    dealt = grouped.join(sizes, "hub").withColumn("block", F.pmod(F.xxhash64("cid", "hub"), F.col("blocks")).cast("int"))
    dealt = dealt.select("row", F.struct("hub", "block", "blocks", "cid", "component").alias("to"))
    wanted = stash(dealt.groupBy("row").agg(F.collect_list("to").alias("to")), "wanted")
    small = wanted.count() <= SENT
    texts = docs.join(F.broadcast(wanted) if small else wanted, "row").select("to", "text")
    names = ["hub", "i", "j", "block", "cid", "component", "shingles"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for to, shingles in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                raw = shingles.tobytes()
                for t in to:
                    for other in range(t["blocks"]):
                        out.append((t["hub"], min(t["block"], other), max(t["block"], other), t["block"], t["cid"], t["component"], raw))
                    held += len(raw) * t["blocks"]
                if held >= 1 << 22:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, held = [], 0
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, right = None, [], []

        def done() -> list[tuple[int, int]]:
            if at is None or not left:
                return []
            return compare_blocks(left, left if at[1] == at[2] else right) if right or at[1] == at[2] else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            for hub, i, j, block, cid, component, raw in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if at != (hub, i, j):
                    out += done()
                    at, left, right = (hub, i, j), [], []
                (left if block == i else right).append((cid, component, np.frombuffer(raw, np.uint64)))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        out = done()
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    sent = map_arrow(texts, send, "hub long, i int, j int, block int, cid long, component long, shingles binary")
    met = sent.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "block")
    return stash(map_arrow(met, compare, "a long, b long").distinct(), "remaining")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, row, n_shingles, component_id, component`` for each row of ``docs(doc_id, text)``.

    Documents with equal sets are one class; classes whose sets have 100 * intersection >= 80 * union are linked.
    ``component_id`` is the smallest doc_id reachable by links, its own included; a null id counts only where all are
    null. A null, empty or wordless text has no shingles and is its own component. Only
    components are given, no links: of a large group no more are verified than connect it. ``row`` tells apart unequal
    rows with one doc_id, ``component`` groups without any id; it is null where there are no shingles. Texts are compared
    whole however long, rows repeated whole are one class, columns other than the two are left, also ones with clashing
    names, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))

    def size_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), *(keys_of(s) if len(s) else (0, 0))) for s in shingle_sets(batch.column(2))]
            columns = list(zip(*sets, strict=True)) or [[], [], []]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "row", "n_shingles", "g1", "g2"])

    sized = stash(map_arrow(docs.select("doc_id", "row", "text"), size_up, "doc_id long, row long, n_shingles long, g1 long, g2 long"), "sizes")
    classes = sized.filter("n_shingles > 0").groupBy("g1", "g2").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"))
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    held = sized.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // ENTRIES))  # a shingle gives at most about an entry
    buckets = bucket_pairs(docs, parts, common_signatures(docs, parts))
    links = verified(docs, classes, buckets.filter("hub is null").select("a", "b").distinct())
    found = stash(components(links), "components")
    members = buckets.filter("hub is not null")
    held = lambda: found.select(F.col("node").alias("a"), F.col("component").alias("b"))  # noqa: E731, B023
    # first one of each component of a bucket with the others, then what is still apart in full
    few = remaining(docs, members, classes, found, first_only=True)
    if not few.isEmpty():
        found = stash(components(held().unionByName(few)), "components")
    found = components(held().unionByName(remaining(docs, members, classes, found)))
    joined = classes.join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(smallest, "component").select("g1", "g2", "component_id", "component")
    alone = sized.filter("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return sized.filter("n_shingles > 0").join(named, ["g1", "g2"]).select("doc_id", "row", "n_shingles", "component_id", "component").unionByName(alone)
