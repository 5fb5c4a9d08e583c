"""Images fetched over HTTP by tasks, with bounds on calls, and taken up again where a run ended."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import importable

FETCHED = "record_id long, url string, status int, asked int, content binary, error string"
#: bytes of bodies that a batch has about
BATCH_BYTES = 1 << 24


def get(url: str, seconds: float = 30) -> tuple[int, bytes]:
    """Status and body; a status that isn't a success is no error here."""
    try:
        with urllib.request.urlopen(url, timeout=seconds) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def asked(call: Callable[[str], tuple[int, bytes]], url: str, tries: int, pause: float) -> tuple[int | None, int, bytes | None, str | None]:
    """Status, how often it was asked for, body or null, error. Only a status of 200 with a body counts; between tries there
    is a pause, twice as long each time. An address that isn't there (404, 410) isn't asked for again."""
    status, said = None, "no body"
    for n in range(1, tries + 1):
        try:
            status, body = call(url)
            if status == 200 and body:
                return status, n, body, None
            said = f"status {status}" if status != 200 else "no body"
            if status in (404, 410):
                return status, n, None, said
        except (OSError, ValueError) as e:
            said = f"{type(e).__name__}: {e}"
        if n < tries:
            time.sleep(pause * 2 ** (n - 1))
    return status, tries, None, said


def fetched(rows: DataFrame, side_by_side: int = 8, per_host: int = 2, tries: int = 3, pause: float = 0.5, call: Callable[[str], tuple[int, bytes]] = get) -> DataFrame:
    """``record_id, url, status, asked, content, error`` of ``rows(record_id, url)``.

    A host's rows are dealt to ``per_host`` tasks and each task has ``side_by_side`` calls open, so a host never has more than
    their product, however many rows it has. A task holds as many bodies as it has calls open, and a batch of them. Rows
    without an address come back with an error. Each evaluation asks again: write the result (``fetch_new``).
    """
    importable(rows.sparkSession)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("record_id", "url").repartition(parts, host_of("url"), F.pmod(F.xxhash64("record_id"), F.lit(per_host)))
    names = [c.split()[0] for c in FETCHED.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row: tuple[int | None, str | None]) -> tuple:
            return (*row, *(asked(call, row[1], tries, pause) if row[1] else (None, 0, None, "no address")))

        with ThreadPoolExecutor(side_by_side) as pool:
            for batch in batches:
                todo, held, size = list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), [], 0
                for at in range(0, len(todo), side_by_side):
                    held += pool.map(one, todo[at : at + side_by_side])
                    size += sum(len(r[4] or b"") for r in held[-side_by_side:])
                    if size >= BATCH_BYTES:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return dealt.mapInArrow(run, FETCHED)


def fetch_new(spark: SparkSession, rows: DataFrame, path: str, **bounds) -> DataFrame:
    """Appends to the Parquet table at ``path`` what ``fetched`` gives for rows that have no body there yet, and gives the
    rows of this run without their bodies. Rows of a run that fails are not in the table, and are asked for by the next."""
    schema, run = f"{FETCHED}, run string", uuid.uuid4().hex
    try:
        there = spark.read.schema(schema).parquet(path)
    except Exception as e:  # nothing fetched yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = spark.createDataFrame([], schema)
    todo = rows.join(there.filter("content is not null").select("record_id"), "record_id", "left_anti")
    fetched(todo, **bounds).withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).filter(F.col("run") == run).drop("run", "content")
