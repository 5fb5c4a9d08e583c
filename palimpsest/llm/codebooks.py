"""Compress vectors to a few codes each: one codebook for each part of the vector, fitted by Yinyang's form of Lloyd's rounds.

Entries of a codebook are put in groups once. Between rounds a vector keeps, for each part, its entry and for each group a
lower bound of the distance to the group's entries other than that one. When entries have moved, the bound falls by the
largest move in the group, and only groups whose bound isn't above the exact distance to the vector's own entry are scanned.
Bounds are rounded down and never decide anything but whether to look: distances are of integers and exact, and equal ones
go to the lower index.

A round is one pass over a written table of vectors with their bounds. A task adds up the parts of its vectors by entry and
leaves the sums as one more row; what the driver sees is as large as the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.base import map_arrow, pick
from palimpsest.session import scratch, spread, stash

#: labels up to which their sums are broadcast; beyond, they are joined by shuffle, with each label in SALTS parts
MOST_LABELS, SALTS = 100_000, 32
#: beyond these the squared distances of integers are exact as doubles, and as 64-bit integers
EXACT_DOUBLE, EXACT_LONG = 2.0**53, 2.0**63


def fixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column of cells of equal size, as rows of ``width`` numbers."""
    n, size = len(column), np.dtype(kind).itemsize * width
    if not n or not size:
        return np.zeros((n, width), kind)
    start = int(np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0])
    return np.frombuffer(column.buffers()[2], np.uint8, n * size, start).view(kind).reshape(n, width)


def cells(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as a binary column."""
    rows = np.ascontiguousarray(rows)
    size = rows.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def grouped(book: np.ndarray, groups: int, rounds: int = 5) -> list[np.ndarray]:
    """The entries of a codebook in at most ``groups`` groups of near ones (indexes ascending, no group empty)."""
    points = book.astype(float)
    centres = points[np.linspace(0, len(points) - 1, min(groups, len(points))).astype(int)]
    for _ in range(rounds):
        own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[own == g].mean(axis=0) if (own == g).any() else c for g, c in enumerate(centres)])
    return [np.flatnonzero(own == g) for g in range(len(centres)) if (own == g).any()]


def check_bound(x: np.ndarray, entries: np.ndarray) -> float:
    """What no squared distance exceeds; an error beyond 64 bits."""
    most = 2.0 * max(float(np.abs(x).max(initial=0)), float(np.abs(entries).max(initial=0)))
    bound = x.shape[1] * most * most
    if bound >= EXACT_LONG:
        raise ValueError(f"components of up to {most / 2:.0f} give distances beyond 64 bits")
    return bound


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as doubles where those hold them and as 64-bit integers else."""
    if check_bound(x, entries) < EXACT_DOUBLE:
        a, b = x.astype(float), entries.astype(float)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - entries[None, :, j]) ** 2
    return out


def below(roots: np.ndarray) -> np.ndarray:
    """Bounds in 32 bits, not above what they were."""
    return np.nextafter(roots.astype(np.float32), np.float32(-np.inf))


def first_scan(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries, their squared distances, and the lower bound of each group, by looking at all entries."""
    every = distances(x, book)
    codes = every.argmin(axis=1)
    own = every[np.arange(len(x)), codes].astype(np.int64)
    far = every.astype(float)
    far[np.arange(len(x)), codes] = np.inf
    lower = np.stack([far[:, g].min(axis=1) for g in groups], axis=1)
    return codes, own, below(np.sqrt(lower))


def next_scan(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray], moved: np.ndarray, codes: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from the last round's, where ``moved`` says how far each entry went; and how many distances were looked at."""
    at = np.arange(len(x))
    # the own entry's distance is worked out anew for every row: that is the tightest upper bound
    check_bound(x, book)
    off = x - book[codes]
    same, looked = (off * off).sum(axis=1), len(x)
    drift = np.array([moved[g].max() for g in groups]) * (1 + 1e-12)
    lower = lower.astype(float) - drift[None]
    scan = lower <= (np.sqrt(same.astype(float)) * (1 + 1e-9))[:, None]
    best, best_at = same.copy(), codes.copy()
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g, members in enumerate(groups):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows):
            continue
        d = distances(x[rows], book[members])
        looked += d.size
        lead = d.argmin(axis=1)
        d0, e0 = d[np.arange(len(rows)), lead].astype(np.int64), members[lead]
        better = (d0 < best[rows]) | ((d0 == best[rows]) & (e0 < best_at[rows]))
        best[rows[better]], best_at[rows[better]] = d0[better], e0[better]
        seen[g] = rows, d
    group_of = np.zeros(len(book), np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    for g, (rows, d) in seen.items():
        others = d.astype(float)
        mine = group_of[best_at[rows]] == g
        others[np.flatnonzero(mine), np.searchsorted(groups[g], best_at[rows[mine]])] = np.inf
        lower[rows, g] = np.sqrt(others.min(axis=1))
    left = (best_at != codes) & ~scan[at, group_of[codes]]  # their old entry is now one of the others in a group not scanned
    old = group_of[codes[left]]
    lower[at[left], old] = np.minimum(lower[at[left], old], np.sqrt(same[left].astype(float)))
    return best_at, best, below(lower), looked


class Books:
    """The codebooks of all parts, their groups, and the moves of the last round."""

    def __init__(self, first: np.ndarray, parts: int, groups: int) -> None:
        """``first``: the vectors that the codebooks start as, in order."""
        self.parts, self.width = parts, first.shape[1] // parts
        self.books = [first[:, p * self.width : (p + 1) * self.width].copy() for p in range(parts)]
        self.groups = [grouped(b, groups) for b in self.books]
        self.moved: list[np.ndarray] | None = None

    @property
    def entries(self) -> int:
        return len(self.books[0])

    def most_groups(self) -> int:
        return max(map(len, self.groups))

    def update(self, counts: np.ndarray, sums: np.ndarray) -> None:
        """Each entry becomes the floor of the mean of its parts; one without parts stays."""
        self.moved = []
        for p, book in enumerate(self.books):
            new = book.copy()
            used = counts[p] > 0
            new[used] = sums[p][used] // counts[p][used][:, None]
            self.moved.append(np.sqrt(((new - book).astype(float) ** 2).sum(axis=1)))
            self.books[p] = new

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def assign(books: Books, x: np.ndarray, codes: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, squared distances summed over parts, and the bounds of all parts side by side, for whole vectors."""
    most = books.most_groups()
    new_codes, error = np.zeros((len(x), books.parts), np.uint16), np.zeros(len(x), np.int64)
    new_lower = np.full((len(x), books.parts * most), np.inf, np.float32)
    for p, (book, groups) in enumerate(zip(books.books, books.groups, strict=True)):
        part, at = x[:, p * books.width : (p + 1) * books.width], slice(p * most, p * most + len(groups))
        if codes is None:
            found, d, bounds = first_scan(part, book, groups)
        else:
            found, d, bounds, _ = next_scan(part, book, groups, books.moved[p], codes[:, p].astype(np.int64), lower[:, at])
        new_codes[:, p], new_lower[:, at] = found, bounds
        error += d
    return new_codes, error, new_lower


def whole_numbers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of vectors without nulls, all of ``width`` components."""
    lens = np.diff(column.offsets.to_numpy())
    if len(lens) and (lens != width).any():
        raise ValueError(f"vectors of {int(lens[lens != width][0])} components among those of {width}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(flat * scale)
    if len(out) and np.abs(out).max() >= 2**31:
        raise ValueError("components beyond 31 bits")
    return out.astype(np.int32).reshape(len(lens), width)


def compress(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, groups: int = 16) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each vector without null or non-finite components.

    Codebooks start as the parts of the ``entries`` vectors with the smallest ids (null ids last, equal ids by their
    vectors; fewer vectors make smaller codebooks). ``code`` has two hex digits a part while ``entries`` is at most 256, and
    four beyond. Rows with a null label are one group of ``label_error``. Repeated rows are all kept. No row of such a kind
    gives an empty result. Vectors of different lengths, a length that ``parts`` doesn't divide, or components too large
    for exact distances are an error. Other columns, also ones with clashing names, are left.
    """
    spark = df.sparkSession
    df = pick(df, "vec_id", "embedding", "label")
    label_type = df.schema["label"].dataType.simpleString()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.filter(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    digits = 2 if entries <= 256 else 4
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {df.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    width = len(first[0]["embedding"])
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    books = Books(whole_numbers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), width, scale).astype(np.int64), parts, groups)
    slots, size = books.entries, books.width + 1
    held = f"vec_id {df.schema['vec_id'].dataType.simpleString()}, label {label_type}"

    def round_of(state: DataFrame, books: Books, started: bool, final: bool) -> DataFrame:
        most = books.most_groups()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums, id_types = np.zeros((parts, slots), np.int64), np.zeros((parts, slots, books.width), np.int64), None
            for batch in batches:
                id_types = [batch.column(0).type, batch.column(1).type]
                if started:
                    v = fixed(batch.column(2), "<i4", width)
                    codes, lower = fixed(batch.column(3), "<u2", parts), fixed(batch.column(4), "<f4", parts * most)
                else:
                    v, codes, lower = whole_numbers(batch.column(2), width, scale), None, None
                x = v.astype(np.int64)
                codes, error, lower = assign(books, x, codes, lower)
                if final:
                    hexed = codes.astype(f">u{digits // 2}").tobytes().hex()
                    step = digits * parts
                    yield pa.record_batch([batch.column(0), batch.column(1), pa.array([hexed[i * step : (i + 1) * step] for i in range(len(x))], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])
                    continue
                for p in range(parts):
                    counts[p] += np.bincount(codes[:, p], minlength=slots)
                    np.add.at(sums[p], codes[:, p].astype(np.int64), x[:, p * books.width : (p + 1) * books.width])
                yield pa.record_batch([batch.column(0), batch.column(1), cells(v), cells(codes), cells(lower), pa.nulls(len(x), pa.binary())], names=STATE)
            if id_types and not final:
                total = np.concatenate([counts[:, :, None], sums], axis=2)
                yield pa.record_batch([*(pa.nulls(1, t) for t in id_types), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([total.tobytes()], pa.binary())], names=STATE)

        return map_arrow(state, run, f"{held}, code string, error long" if final else f"{held}, v binary, codes binary, lower binary, sums binary")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * slots * size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, np.int64)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["slot", "n"])

    state = spread(kept.select("vec_id", "label", "embedding"))
    state = state.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    old: str | None = None
    for turn in range(rounds):
        path = scratch(spark, "vectors")
        out = round_of(state, books, turn > 0, False)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
        out.write.option("compression", "zstd").parquet(path)
        if old:
            _delete(df, old)
        old, written = path, spark.read.schema(schema).parquet(path)
        total = np.zeros(parts * slots * size, np.int64)
        sums = map_arrow(written.filter("sums is not null").select("sums"), summed, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        for row in sums.collect():  # as many as the codebooks have numbers
            total[row["slot"]] = row["n"]
        total = total.reshape(parts, slots, size)
        books.update(total[:, :, 0], total[:, :, 1:])
        state = written.filter("sums is null").select("vec_id", "label", "v", "codes", "lower")
    coded = stash(round_of(state, books, rounds > 0, True), "codes")
    if old:
        _delete(df, old)
    return _with_label_error(coded).withColumn("codebooks_sha256", F.lit(books.sha256())).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


STATE = ["vec_id", "label", "v", "codes", "lower", "sums"]


def _delete(df: DataFrame, path: str) -> None:
    """A round's table goes when the next one is written, so that two at most take room."""
    spark = df.sparkSession
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _with_label_error(coded: DataFrame, most: int | None = None) -> DataFrame:
    """Adds the sum of errors over rows of equal label; a label may have any share of the rows, and there may be any number of labels."""
    most = MOST_LABELS if most is None else most
    sums = stash(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    if sums.limit(most + 1).count() <= most:
        sums = F.broadcast(sums.withColumnRenamed("label", "same_label"))
        return coded.join(sums, F.col("label").eqNullSafe(F.col("same_label")))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)))
    sums = sums.select(F.col("label").alias("same_label"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("same_salt"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("same_label")) & (F.col("salt") == F.col("same_salt")))


def codebook_sql(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same by plain rounds over all entries, for DuckDB."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT row, p, v[p * {width} + 1 : (p + 1) * {width}] AS x FROM kept, range({parts}) t(p)
), book0 AS MATERIALIZED (SELECT p, row - 1 AS e, x FROM cut WHERE row <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT c.row, c.p, min(list_sum(list_transform(list_zip(c.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * {entries} + b.e) AS best
  FROM cut c JOIN book{r} b ON c.p = b.p GROUP BY c.row, c.p
)""")
        if r < rounds:
            steps.append(f"""spread{r} AS (
  SELECT n.p, CAST(n.best % {entries} AS BIGINT) AS e, unnest(c.x) AS x, generate_subscripts(c.x, 1) AS pos FROM near{r} n JOIN cut c ON n.row = c.row AND n.p = c.p
), mean{r} AS (
  SELECT p, e, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM spread{r} GROUP BY p, e, pos
), book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (SELECT p, e, list(x ORDER BY pos) AS x FROM mean{r} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e
)""")
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT row, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY row
), digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), digest
"""
