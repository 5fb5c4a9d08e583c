"""Token ids in files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

A written set is a table in a folder. Each row is a frame: consecutive documents in ascending doc_id order, as one binary
value in the format of ``pack_frame``. Within a frame every ``BLOCK`` ids begin a block whose bit offset is kept, so that
blocks decode independently (here: side by side, one vector step for each position in a block).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.base import map_arrow, pick, text_of
from palimpsest.llm.wordids import word_ids
from palimpsest.session import stash

MAGIC, VERSION, BLOCK, MAX_BITS = b"PLHF", 2, 128, 16
HEADER = struct.Struct("<4sHHqqqq")  # magic, version, ids in a block, ids before it in its part, documents, ids, bytes of code


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits by package-merge; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << most:
        raise ValueError(f"{n} ids don't fit in codes of {most} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.float64)
    is_item: list[np.ndarray] = []
    packages = np.zeros(0)
    for _ in range(most):
        both = np.concatenate([weights, packages])
        by = np.argsort(both, kind="stable")
        is_item.append(by < n)
        merged = both[by]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    need, depth = 2 * n - 2, np.zeros(n, np.uint8)
    for kinds in reversed(is_item):
        items = int(kinds[:need].sum())
        depth[:items] += 1
        need = 2 * (need - items)
    lengths[order] = depth
    return lengths


class Code:
    """The canonical code of given lengths: codes ascend by (length, id)."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.uint8)
        self.codes = np.zeros(len(lengths), np.uint32)
        ids = np.flatnonzero(lengths)
        order = ids[np.lexsort((ids, lengths[ids]))]
        spans = np.left_shift(1, MAX_BITS - lengths[order].astype(np.int64))
        starts = np.cumsum(spans) - spans  # of each id's share of all 16-bit windows
        self.codes[order] = starts >> (MAX_BITS - lengths[order].astype(np.int64))
        self.long_lengths = lengths.astype(np.int64)
        #: each code at the top of 64 bits
        self.high = np.left_shift(self.codes.astype(np.uint64), ((64 - self.long_lengths) & 63).astype(np.uint64))
        self.symbol = np.zeros(1 << MAX_BITS, np.uint32)
        self.width = np.ones(1 << MAX_BITS, np.uint8)
        total = int(spans.sum())
        self.symbol[:total] = np.repeat(order, spans)
        self.width[:total] = np.repeat(lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, padded to whole 32-bit words, and the bit offset of each block."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        if len(ids) % 2:  # codes go in by pairs; the last one's partner is nothing
            widths, high = np.append(self.long_lengths[ids], 0), np.append(self.high[ids], np.uint64(0))
        else:
            widths, high = self.long_lengths[ids], self.high[ids]
        left = widths[0::2]
        ends = np.cumsum(left + widths[1::2])
        at = ends - left - widths[1::2]
        value = (high[0::2] | (high[1::2] >> left.astype(np.uint64))) >> (at & 31).astype(np.uint64)
        first = np.flatnonzero(np.diff(at >> 5, prepend=-1))  # a pair has at most 32 bits, so every word has a first one
        out = np.zeros(len(first) + 1, np.uint64)
        out[:-1] |= np.bitwise_or.reduceat(value >> np.uint64(32), first)
        out[1:] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out[: (int(ends[-1]) + 31) // 32].astype(">u4").tobytes(), at[:: BLOCK // 2]

    def decode(self, bits: bytes, starts: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((len(starts), BLOCK), np.uint32)
        padded = bits + b"\0" * 8
        window = np.ndarray(len(padded) - 3, ">u4", padded, strides=(1,))
        at = starts.astype(np.int64).copy()
        full = n // BLOCK
        for step in range(BLOCK):
            live = len(starts) if step < n - full * BLOCK or full == len(starts) else full
            here = at[:live]
            key = (window[here >> 3].astype(np.uint32) << (here & 7).astype(np.uint32)) >> np.uint32(16)
            out[:live, step] = self.symbol[key]
            here += self.width[key]
        return out.reshape(-1)[:n]


def pack_frame(code: Code, before: int, doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> bytes:
    """Header, doc ids (8 bytes each), which of them are null (a bit each; ``doc_ids`` may be masked), their id counts (8 bytes
    each), bits of each block (2 bytes each), code words."""
    bits, starts = code.encode(ids)
    widths = np.diff(starts).astype("<u2").tobytes()
    head = HEADER.pack(MAGIC, VERSION, BLOCK, before, len(lens), len(ids), len(bits))
    return head + id_bytes(doc_ids) + lens.astype("<i8").tobytes() + widths + bits


def id_bytes(doc_ids: np.ndarray) -> bytes:
    """8 bytes for each id, then a bit for each, set where it is null."""
    return np.ma.filled(doc_ids, 0).astype("<i8").tobytes() + np.packbits(np.ma.getmaskarray(doc_ids)).tobytes()


def ids_from(raw: bytes, n: int, at: int = 0) -> np.ma.MaskedArray:
    null = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at + 8 * n), count=n).astype(bool)
    return np.ma.array(np.frombuffer(raw, "<i8", n, at), mask=null)


def unpack_frame(code: Code, raw: bytes) -> tuple[int, np.ma.MaskedArray, np.ndarray, np.ndarray]:
    """Ids before it in its part, doc ids (null ones masked), id counts, all ids."""
    magic, version, block, before, docs, n, size = HEADER.unpack_from(raw)
    if magic != MAGIC or version != VERSION or block != BLOCK:
        raise ValueError("not a frame of this format")
    at = HEADER.size
    doc_ids = ids_from(raw, docs, at)
    at += 8 * docs + -(-docs // 8)
    lens = np.frombuffer(raw, "<i8", docs, at)
    at += 8 * docs
    blocks = -(-n // BLOCK)
    widths = np.frombuffer(raw, "<u2", max(0, blocks - 1), at).astype(np.int64)
    at += 2 * max(0, blocks - 1)
    starts = np.concatenate([[0], np.cumsum(widths)])[:blocks]
    return before, doc_ids, lens, code.decode(raw[at : at + size], starts, n)


def quantiles(ids: DataFrame, parts: int) -> list[int]:
    """At most ``parts - 1`` values of doc_id that cut its rows into even ranges; only that column is read."""
    if parts < 2:
        return []
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def part_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are below a value, found in two steps of about the root of their number; 0 for null."""
    if not bounds:
        return F.lit(0)
    width = int(np.ceil(np.sqrt(len(bounds))))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    lits = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    row = F.size(F.filter(lits([r[-1] for r in rows]), lambda b: b < value))
    inside = F.size(F.filter(F.get(F.array(*[lits(r) for r in rows]), row), lambda b: b < value))
    return F.coalesce(F.when(value.isNull(), 0).when(row >= len(rows), len(bounds)).otherwise(row * width + inside), F.lit(0)).cast("int")


def ids_of(tokenizer: str) -> int:
    """One more than the largest id a tokenizer gives."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab().values()) + 1


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, vocabulary: int | None = None, frame_ids: int = 1 << 19) -> None:
    """Encode ``docs(doc_id, text)`` and write frames under ``path`` in ascending doc_id order (null ids first).

    Texts are dealt out by ranges of doc_id, encoded once, and kept as plain 16- or 32-bit ids in the shared folder until
    the counts of all of them have given the code. Rows with the same doc_id all stay, ordered by their text's hash.
    A null or empty text is its end id alone. An empty table gives no frame and a code without ids. Texts are encoded whole
    however long, one at a time beyond a batch; columns other than the two, also ones with clashing names, are left.
    ``vocabulary`` is what the tokenizer's file says unless given; an id beyond it is an error. Codes have 16 bits at most,
    so at most 65 536 different ids may occur.
    """
    vocabulary = max(end_id + 1, ids_of(tokenizer) if vocabulary is None else vocabulary)
    plain = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, seen = word_ids(tokenizer), 0, np.zeros(vocabulary, np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting, part = 0, -1

        def frame() -> pa.RecordBatch:
            nonlocal before, waiting
            doc_ids, lens, ids = (join(x) for join, x in zip((np.ma.concatenate, np.concatenate, np.concatenate), zip(*held, strict=True), strict=True))
            held.clear()
            row = [part, before, id_bytes(doc_ids), lens.astype("<i8").tobytes(), ids.astype(plain).tobytes(), None]
            before, waiting = before + len(ids), 0
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, RAW, strict=True)], names=RAW_NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            ids, lens = encoder.encode(batch.column(1))
            lens = lens + 1
            if len(ids) and int(ids.max()) >= vocabulary:
                raise ValueError(f"id {int(ids.max())} is beyond a vocabulary of {vocabulary}")
            whole = np.full(int(lens.sum()), end_id, np.uint32)
            keep = np.ones(len(whole), bool)
            keep[np.cumsum(lens) - 1] = False
            whole[keep] = ids
            seen += np.bincount(whole, minlength=vocabulary)
            doc_ids = np.ma.array(pc.fill_null(batch.column(0), 0).to_numpy(), mask=pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False))
            held.append((doc_ids, lens, whole))
            waiting += len(whole)
            if waiting >= frame_ids:
                yield frame()
        if held:
            yield frame()
        if part >= 0:
            used = np.flatnonzero(seen)
            row = [part, -1, None, None, None, used.astype("<i8").tobytes() + seen[used].astype("<i8").tobytes()]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, RAW, strict=True)], names=RAW_NAMES)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                total[ids] += n
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    docs = pick(docs, "doc_id", "text")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        docs.withColumn("text", text_of())
        .repartitionById(parts, part_of(F.col("doc_id"), quantiles(docs.select("doc_id"), parts)))
        .withColumn("h", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    )
    raw = stash(map_arrow(ordered, encode, RAW_SCHEMA), "ids")
    counts = np.zeros(vocabulary, np.int64)
    sums = map_arrow(raw.filter("counts is not null").select("counts"), counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for row in sums.collect():  # at most one row for each id of the vocabulary
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for part, before, doc_ids, lens, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                payload = pack_frame(code, before, ids_from(doc_ids, len(lens) // 8), np.frombuffer(lens, "<i8"), np.frombuffer(ids, plain))
                yield pa.record_batch([pa.array([part]), pa.array([before]), pa.array([len(ids) // np.dtype(plain).itemsize]), pa.array([payload], pa.binary())], names=["part", "before", "n_ids", "frame"])

    frames = map_arrow(raw.filter("counts is null").drop("counts"), coded, "part long, before long, n_ids long, frame binary")
    frames.write.option("compression", "none").parquet(f"{path}/frames")
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")


RAW = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
RAW_NAMES = ["part", "before", "doc_ids", "lens", "ids", "counts"]
RAW_SCHEMA = "part long, before long, doc_ids binary, lens binary, ids binary, counts binary"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of a written set: ``doc_id, start, n_tokens, ids_crc32`` and the ids themselves."""
    return _read(spark, path, with_ids=True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, with_ids=False)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    code_row = spark.read.parquet(f"{path}/code").first()
    lengths = np.frombuffer(bytes(code_row["lengths"]), np.uint8)
    frames = spark.read.schema("part long, before long, n_ids long, frame binary").parquet(f"{path}/frames")
    offsets, at = {}, 0
    for row in frames.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row for each written part
        offsets[row["part"]], at = at, at + row["n"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before, doc_ids, lens, ids = unpack_frame(code, raw)
                ends = np.cumsum(lens)
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                columns = [pa.array(doc_ids.data, pa.int64(), mask=np.ma.getmaskarray(doc_ids)), pa.array(ends - lens + before + offsets[part], pa.int64()), pa.array(lens, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    return map_arrow(frames.select("part", "frame"), decoded, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
