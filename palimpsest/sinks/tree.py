"""Trees of files, one for each row, written so that a failed, repeated or killed task leaves nothing behind.

A task attempt writes below a folder of its own, with a list of what should become what. Spark commits one attempt of each
task; the commit names these attempts in one small file. Only then files are moved to their places, by executors, from the
attempts that the commit names. A run that breaks before the commit leaves no file in place; one that breaks after it is
ended by ``publish``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs  # noqa: F401  makes pa.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from palimpsest.session import importable, stash

STAGING, COMMITTED, LISTED = "_staging", "_committed", "_listed"
#: repeated names that are broadcast at most
MOST_REPEATED = 100_000


def at(base: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pa.fs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (pa.fs.LocalFileSystem(), base)


def below(folder: str | None, name: str) -> str:
    """A file's path below the root; an error where it would be elsewhere, or where the tree keeps what isn't committed."""
    path = "/".join(x for x in (folder, name) if x)
    parts = path.split("/")
    if not name or path.startswith("/") or "\0" in path or "\\" in path or any(p in ("", ".", "..") for p in parts) or parts[0] == STAGING:
        raise ValueError(f"{path!r} is no name of a file in the folder")
    return path


@dataclass
class Attempt(WriterCommitMessage):
    """What a task attempt has staged."""

    name: str
    files: int


class TreeWriter(DataSourceArrowWriter):
    """Stages ``folder, name, content`` of an attempt; the commit lists the attempts that count."""

    def __init__(self, base: str, run: str) -> None:
        self.base, self.run = base, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, root = at(self.base)
        name, files = uuid.uuid4().hex, 0
        staged = f"{root.rstrip('/')}/{STAGING}/{self.run}/{name}"
        store.create_dir(staged, recursive=True)
        with store.open_output_stream(f"{staged}/{LISTED}") as listed:
            for batch in iterator:
                for folder, leaf, content in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "content")), strict=True):
                    path = below(folder, leaf)
                    there = store.get_file_info(f"{root.rstrip('/')}/{path}")
                    fresh = there.type != pa.fs.FileType.File or (not there.size and bool(content))
                    if fresh:
                        with store.open_output_stream(f"{staged}/{files:08}") as out:
                            out.write(content or b"")
                    listed.write(json.dumps([path, f"{files:08}" if fresh else None]).encode() + b"\n")
                    files += fresh
        return Attempt(name, files)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, root = at(self.base)
        folder = f"{root.rstrip('/')}/{STAGING}/{self.run}"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{COMMITTED}.part") as out:
            out.write("".join(f"{m.name}\n" for m in messages if m).encode())
        store.move(f"{folder}/{COMMITTED}.part", f"{folder}/{COMMITTED}")

    def abort(self, messages: list[Attempt | None]) -> None:
        discard(self.base, self.run)


class TreeSource(DataSource):
    """``df.write.format("palimpsest_tree")`` of ``folder, name, content``, with the options ``base`` and ``run``."""

    @classmethod
    def name(cls) -> str:
        return "palimpsest_tree"

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["base"], self.options["run"])


def discard(base: str, run: str) -> None:
    """What a run has staged goes."""
    store, root = at(base)
    folder = f"{root.rstrip('/')}/{STAGING}/{run}"
    if store.get_file_info(folder).type == pa.fs.FileType.Directory:
        store.delete_dir(folder)
    above = folder.rpartition("/")[0]
    if store.get_file_info(above).type == pa.fs.FileType.Directory and not store.get_file_info(pa.fs.FileSelector(above)):
        store.delete_dir(above)


def publish(spark: SparkSession, base: str, run: str) -> DataFrame:
    """Moves what a committed run has staged to its places, by executors, and gives ``path, written``. May be called again
    after a failure: files that were moved are there, and count as written."""
    importable(spark)
    store, root = at(base)
    root = root.rstrip("/")
    with store.open_input_stream(f"{root}/{STAGING}/{run}/{COMMITTED}") as marker:
        attempts = marker.read().decode().split()  # one for each task

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, made = at(base)[0], set()
        for batch in batches:
            for attempt in batch.column(0).to_pylist():
                staged = f"{root}/{STAGING}/{run}/{attempt}"
                with files.open_input_stream(f"{staged}/{LISTED}") as listed:
                    lines = [json.loads(x) for x in listed.read().splitlines()]
                for path, name in lines:
                    folder = f"{root}/{path}".rpartition("/")[0]
                    if name and folder not in made:
                        files.create_dir(folder, recursive=True)
                        made.add(folder)
                    if name and files.get_file_info(f"{staged}/{name}").type == pa.fs.FileType.File:
                        files.move(f"{staged}/{name}", f"{root}/{path}")
                yield pa.record_batch([pa.array([f"{root}/{p}" for p, _ in lines], pa.string()), pa.array([n is not None for _, n in lines], pa.bool_())], names=["path", "written"])

    rows = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(max(1, len(attempts)))
    out = stash(rows.mapInArrow(move, "path string, written boolean"), "written")
    discard(base, run)
    return out


def once_each(rows: DataFrame) -> DataFrame:
    """Rows ``folder, name, content`` without repeated names: of different contents the one with the smallest hash stays.

    Only hashes are grouped; contents move where a name is repeated.
    """
    hashed = rows.withColumn("h", F.xxhash64("content"))
    repeated = stash(hashed.groupBy("folder", "name").agg(F.count("*").alias("n"), F.min("h").alias("h")).filter("n > 1").drop("n"), "repeated")
    n = repeated.limit(MOST_REPEATED + 1).count()
    if not n:
        return rows
    names = repeated.select(F.col("folder").alias("f"), F.col("name").alias("m"), F.col("h").alias("kept"))
    own = F.col("folder").eqNullSafe(F.col("f")) & F.col("name").eqNullSafe(F.col("m"))
    names = F.broadcast(names) if n <= MOST_REPEATED else names
    rest = hashed.join(names, own, "left_anti").drop("h")
    chosen = hashed.join(names, own & (F.col("h") == F.col("kept"))).select("folder", "name", "content", "h")
    return rest.unionByName(chosen.dropDuplicates(["folder", "name", "h"]).drop("h"))


def write_tree(rows: DataFrame, base: str) -> DataFrame:
    """Writes each row of ``rows(folder, name, content)`` as a file below ``base`` and gives ``path, written``.

    A file that is there stays, but for an empty one where there is content now. A repeated name is written once; a name
    outside the folder is an error, and then nothing is written.
    """
    spark = rows.sparkSession
    importable(spark)
    spark.dataSource.register(TreeSource)
    run = uuid.uuid4().hex
    try:
        once_each(rows.select("folder", "name", "content")).write.format("palimpsest_tree").option("base", base).option("run", run).mode("append").save()
    except Exception:
        discard(base, run)  # what tasks that were still running staged after the abort
        raise
    return publish(spark, base, run)


def move_files(moves: DataFrame, base: str) -> DataFrame:
    """Moves files below ``base`` as ``moves(source, target)`` says, by executors, and gives ``source, target, moved``.

    Two files for one place, or a place outside the folder, are an error before anything moves. Where the source is gone and
    the target is there (a task that ran before), the file counts as moved; where there is no source and no target, it doesn't.
    """
    spark = moves.sparkSession
    importable(spark)
    moves = stash(moves.select("source", "target").filter(~F.col("source").eqNullSafe(F.col("target"))), "moves")
    twice = moves.groupBy("target").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['count']} files for {twice[0]['target']!r}")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in [*batch.column("source").to_pylist(), *batch.column("target").to_pylist()]:
                below(None, path)
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = at(base)
        root, made = root.rstrip("/"), set()
        for batch in batches:
            done = []
            for source, target in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist(), strict=True):
                here, there = f"{root}/{source}", f"{root}/{target}"
                folder = there.rpartition("/")[0]
                if store.get_file_info(here).type == pa.fs.FileType.File:
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    store.move(here, there)
                done.append(store.get_file_info(there).type == pa.fs.FileType.File)
            yield pa.record_batch([batch.column("source"), batch.column("target"), pa.array(done, pa.bool_())], names=["source", "target", "moved"])

    schema = "source string, target string"
    chain = moves.select(F.col("target").alias("path")).join(moves.select(F.col("source").alias("path")), "path", "left_semi").limit(1).collect()
    if chain:
        raise ValueError(f"{chain[0]['path']!r} is both moved and moved to")
    moves = stash(moves.mapInArrow(checked, schema), "moves")
    return stash(moves.mapInArrow(run, f"{schema}, moved boolean"), "moved")
