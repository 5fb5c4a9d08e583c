"""What the pipelines leave behind: annotations, manifests, metrics, transcriptions, label files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.constants import SPLIT_WEIGHTS
from palimpsest.operators.curation import not_done
from palimpsest.session import importable
from palimpsest.sinks.tree import at, write_tree
from palimpsest.sources import listing


def with_default_split(annotations: DataFrame) -> DataFrame:
    return annotations.withColumn("split", F.coalesce("split", F.lit("train")))


def write_annotations(annotations: DataFrame, path: str) -> None:
    """A folder for each split; rows without one are train. Of the standard splits those without rows get an empty folder."""
    rows, seen = with_default_split(annotations), Observation()
    there = [F.coalesce(F.max(F.col("split") == n), F.lit(False)).alias(n) for n in SPLIT_WEIGHTS]
    rows.observe(seen, *there).write.mode("overwrite").partitionBy("split").json(path)  # texts may be read from files: once
    for split in (n for n in SPLIT_WEIGHTS if not seen.get[n]):
        annotations.drop("split").limit(0).write.mode("overwrite").json(f"{path}/split={split}")


def write_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines ``image, region, text``; letters stay as they are."""
    rows.select("image", "region", "text").write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str, items: DataFrame | None = None) -> None:
    """The report's one JSON text, and the items it is of as JSON lines in ``<path>-items``."""
    report.select(F.col(report.columns[0]).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    if items is not None:
        items.write.mode("overwrite").json(f"{path}-items")


def write_texts(rows: DataFrame, base: str, extension: str = ".md") -> DataFrame:
    """Writes ``rows(subfolder, stem, text)`` as ``<base>/<subfolder>/<stem><extension>``, one file each, where none with
    bytes is there, and gives ``path, written``; a text can be bytes. See ``tree.write_tree`` for names and failures."""
    named = rows.select(F.coalesce("subfolder", F.lit("")).alias("folder"), F.concat("stem", F.lit(extension)).alias("name"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("content"))
    return write_tree(named, base)


def copy_files(files: DataFrame, source: str, target: str, suffixes: list[str] | None = None) -> DataFrame:
    """Copies ``files(path, length)`` below ``source`` (a download or upload of a prefix) to the same places below ``target``,
    those with the suffixes, and gives ``path, copied``; files of the same size that are there already stay."""
    importable(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (here, root), (there, out) = at(source), at(target)
        for batch in batches:
            done = []
            for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rel = path.split(root.rstrip("/") + "/", 1)[-1]
                place = f"{out.rstrip('/')}/{rel}"
                fresh = there.get_file_info(place).size != size
                if fresh:
                    there.create_dir(place.rpartition("/")[0], recursive=True)
                    with here.open_input_stream(f"{root.rstrip('/')}/{rel}") as a, there.open_output_stream(place) as b:
                        while block := a.read(1 << 22):
                            b.write(block)
                done.append(fresh)
            yield pa.record_batch([batch.column(0), pa.array(done, pa.bool_())], names=["path", "copied"])

    chosen = with_suffixes(files, suffixes).select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), "length")
    return chosen.mapInArrow(run, "path string, copied boolean")


def delete_tree(spark: SparkSession, path: str) -> bool:
    """Deletes a folder and all below it; false where there was none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def delete_folders(spark: SparkSession, path: str) -> bool:
    """``delete_tree`` of a folder with many below it, which tasks delete."""
    if not listing.reachable(path):
        return delete_tree(spark, path)
    folders = listing.folders(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = at(path)[0]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                if store.get_file_info(folder).type == pa.fs.FileType.Directory:  # gone with the one above it, or by an attempt before
                    store.delete_dir(folder)
            yield batch.slice(0, 0)

    folders.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
    return delete_tree(spark, path)


def metrics_text(report: DataFrame) -> str:
    """The table of ``scoring.report`` as text: a line for each group, the whole last."""
    rows = report.orderBy("is_total", "subfolder").collect()  # one row for each group
    width = max([8, *(len(r["subfolder"] or "") for r in rows)])
    head = f"{'group':<{width}} {'n':>8} {'cer':>8} {'median':>8} {'wer':>8} {'lev':>8} {'exact':>7}"
    line = lambda r: f"{'ALL' if r['is_total'] else r['subfolder'] or '':<{width}} {r['n']:>8} {r['cer_mean']:>8.4f} {r['cer_median']:>8.4f} {r['wer_mean']:>8.4f} {r['lev_mean']:>8.1f} {r['exact_pct']:>6.1f}%"
    return "\n".join([head, "-" * len(head), *map(line, rows)]) + "\n"


def sections_text(sections: dict[str, DataFrame], most: int = 15) -> str:
    """Text with a heading for each table and its first ``most`` rows, in the table's own order; columns stand under their names."""
    out = []
    for title, df in sections.items():
        rows = [[f"{x:.4f}" if isinstance(x, float) else "" if x is None else repr(x) if str(x).isspace() else str(x) for x in r] for r in df.limit(most).collect()]  # the report's length
        widths = [max(map(len, column)) for column in zip(df.columns, *rows, strict=True)]
        out += [f"=== {title} ===", *("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in [df.columns, *rows]), ""]
    return "\n".join(out)


def append_transcripts(rows: DataFrame, path: str, key: str = "path") -> None:
    """Texts of images that have none there yet."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = rows.select(key).limit(0)
    not_done(rows, done, key).write.mode("append").parquet(path)


def run_summary(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of totals, and the failures by path."""
    failed = F.col("error").isNotNull()
    total = results.agg(F.count("*").alias("images"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return total, results.filter(failed).select("path", "error")


def write_summary(results: DataFrame, path: str) -> DataFrame:
    """Totals in ``<path>/summary`` and failures in ``<path>/failed``; gives the totals.

    Results may come from calls that cost money and differ each time, so they are read once: the pass that writes the
    failures also observes the totals.
    """
    spark, seen = results.sparkSession, Observation()
    failed = F.col("error").isNotNull()
    tokens = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens")]
    watched = results.observe(seen, F.count("*").alias("images"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), *tokens)
    watched.filter(failed).select("path", "error").write.mode("overwrite").json(f"{path}/failed")
    names = "images long, succeeded long, failed long, input_tokens long, output_tokens long"
    total = spark.createDataFrame([tuple(seen.get[n.split()[0]] for n in names.split(", "))], names)
    total.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return total


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """One row for each image: its file, how many regions, the regions in order."""
    region = F.struct("seq", "class_id", "label", "confidence", "x", "y", "width", "height")
    rows = predictions.groupBy(F.col("image").alias("filename")).agg(F.sort_array(F.collect_list(region)).alias("regions"))
    return rows.select("filename", F.size("regions").alias("n_regions"), F.transform("regions", lambda r: r.dropFields("seq")).alias("regions"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    prediction_rows(predictions).write.mode("overwrite").json(path)


def write_transcriptions(lines: DataFrame, path: str) -> None:
    """Name and text, with a tab between them, no header."""
    lines.select("basename", "text").write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path)


def write_detection_metadata(rows: DataFrame, path: str) -> None:
    rows.select("file_name", "objects").write.mode("overwrite").json(path)


def dataset_yaml(path: str, splits: dict[str, str], names: list[str]) -> str:
    """Text of a dataset's description from the row of ``layout.dataset_splits``."""
    places = "".join(f"{k}: images/{splits[k]}\n" for k in ("train", "val", "test"))
    return f"path: {path}\n{places}nc: {len(names)}\nnames:\n" + "".join(f"  {i}: {n}\n" for i, n in enumerate(names))


def with_suffixes(files: DataFrame, suffixes: list[str] | None) -> DataFrame:
    """Files whose path ends with one of the suffixes, or all; what an upload takes."""
    if not suffixes:
        return files
    out = F.lit(False)
    for s in suffixes:
        out = out | F.col("path").endswith(s)
    return files.filter(out)
