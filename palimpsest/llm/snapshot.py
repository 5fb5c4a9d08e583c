"""What changed between two snapshots of a table, where rows may have got new keys.

Rows pair by key first, and what is left over by content. Both times rows are counted off within a run of equal values, so
that the first pairs with the first and so on; the count never needs a run in one place. All rows are sorted by ranges,
each part counts its own runs, and only the run that a part begins with can have started in an earlier part: its rows get
the sum of what those parts hold of it. Joins are on value and count together, so a value with a third of all rows is
spread as evenly as any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.llm.base import map_arrow, pick
from palimpsest.session import stash

EARLIER, LATER = 0, 1
#: what a row of counted runs is: a row of the table, or the count of the first run of its part, of the last, or of the only one
ROW, FIRST, LAST, ONLY = 0, 1, 2, 3


def differs(columns: Sequence[pa.Array]) -> np.ndarray:
    """For each row but the first, whether it differs from the row before; no column holds nulls."""
    n = len(columns[0])
    out = np.zeros(max(0, n - 1), bool)
    for column in columns:
        out |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def run_ranks(df: DataFrame, run: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds ``rank`` (from 1) among rows of equal ``run``, by ``order``.

    ``run`` names columns without nulls. ``order`` should tell all rows apart, as only then can equal rows be split among
    parts. The table is written once, sorted; nothing that grows with it goes to the driver or through one task.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c) for c in run] + list(order)
    ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    fields = [T.StructField(f.name, f.dataType, True) for f in ordered.schema]
    schema = T.StructType([*fields, T.StructField("within", T.LongType()), T.StructField("first", T.BooleanType()), T.StructField("kind", T.IntegerType())])
    types, names = to_arrow_schema(schema), [f.name for f in fields]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        runs = carried = part = 0

        def mark(kind: int) -> pa.RecordBatch:
            values = dict(zip(run, last, strict=True)) | {"part": part, "within": carried, "kind": kind}
            return pa.record_batch([pa.array([values.get(f.name)], f.type) for f in types], schema=types)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c) for c in run]
            head = tuple(c[0].as_py() for c in columns)
            starts = np.concatenate([[head != last], differs(columns)])
            part = batch.column("part")[0].as_py()
            if runs == 1 and starts.any():  # the first run ended with or within what came before this batch or in it
                cut = int(np.argmax(starts))
                carried += cut
                yield mark(FIRST)
                carried -= cut
            at = np.arange(batch.num_rows)
            begun = np.maximum.accumulate(np.where(starts, at, -1))
            within = np.where(begun < 0, at + carried, at - begun)
            number_of = runs + np.cumsum(starts)
            if runs == 0 and number_of[-1] > 1:
                last, carried = head, int(np.argmax(number_of > 1))
                yield mark(FIRST)
            runs, carried = int(number_of[-1]), int(within[-1]) + 1
            last = tuple(c[-1].as_py() for c in columns)
            arrays = [batch.column(c) for c in names] + [pa.array(within), pa.array(number_of == 1), pa.array(np.full(len(at), ROW, np.int32))]
            yield pa.record_batch([a.cast(f.type) for a, f in zip(arrays, types, strict=True)], schema=types)
        if runs:
            yield mark(ONLY if runs == 1 else LAST)

    numbered = stash(map_arrow(ordered, number, schema), "runs")
    earlier_parts = Window.partitionBy(*run).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    marks = numbered.filter(F.col("kind") != ROW).select("part", "kind", F.coalesce(F.sum("within").over(earlier_parts), F.lit(0)).alias("before"))
    first = marks.filter(F.col("kind") != LAST).select("part", "before")  # at most one row a part
    rows = numbered.filter(F.col("kind") == ROW)
    held = [n for n in names if n != "part"]
    within = F.col("within") + 1
    inside = rows.filter(~F.col("first")).select(*held, within.alias("rank"))
    return inside.unionByName(rows.filter("first").join(first, "part").select(*held, (within + F.col("before")).alias("rank")))


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(value.cast("string")))


def _narrow(df: DataFrame, side: int, key: str, columns: Sequence[str]) -> DataFrame:
    """Key, digests and nothing else of each row: what is compared and shuffled instead of texts."""
    df = pick(df, key, *columns).toDF("key", *[f"c{i}" for i in range(len(columns))])
    own = [F.col(f"c{i}") for i in range(len(columns))]
    digests = [_digest(c).alias(f"d{i}") for i, c in enumerate(own)]
    row_sha = F.sha2(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("~")) for c in own]), 256) if side == LATER else F.lit(None).cast("string")
    df = df.select(F.lit(side).alias("side"), "key", *digests, F.unhex(row_sha).alias("row_sha"), F.monotonically_increasing_id().alias("row"))
    held = [F.col(f"d{i}") for i in range(len(columns))]
    content = F.concat(*[F.when(d.isNull(), F.lit("-")).otherwise(F.hex(d)) for d in held])
    return df.withColumns({"content": F.unhex(F.md5(content)), "key_text": F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit(""))})


def _both(ranked: DataFrame, on: str, earlier: dict[str, str], later: dict[str, str]) -> DataFrame:
    """Rows of both sides with equal ``on`` and rank in one row; the other side's columns are null where there is none."""
    sides = []
    for side, names in ((EARLIER, earlier), (LATER, later)):
        sides.append(ranked.filter(F.col("side") == side).select(on, "rank", *[F.col(a).alias(b) for a, b in names.items()], F.lit(True).alias(f"in_{side}")))
    return sides[0].join(sides[1], [on, "rank"], "full")


def snapshot_diff(earlier: DataFrame, later: DataFrame, key: str = "doc_id", columns: Sequence[str] = ("text", "lang", "source")) -> DataFrame:
    """``key, old_key, op, changed, row_sha256``: one row for each pair of rows, and for each row without a partner.

    Rows with equal keys pair (``same``, or ``update`` where ``changed`` lists the differing columns). Of the others, rows
    with equal columns pair by rank, the smallest earlier key with the largest later key (``rekey``). What is left was
    inserted or deleted. ``row_sha256`` is of the later row's columns, a line each, nulls as ``~``.

    Nulls equal only nulls, also as keys, where they are the smallest. Where a key is repeated in a snapshot its rows are
    counted off by content, and the n-th of one pairs with the n-th of the other; what one snapshot has more of is left
    over. Texts are digested whole however long (128-bit digests are compared, nothing longer is shuffled). Other columns,
    also ones with clashing names, are left. Two empty tables give no row; one empty table gives inserts or deletes only.
    """
    columns = list(columns)
    d = [f"d{i}" for i in range(len(columns))]
    rows = stash(_narrow(earlier, EARLIER, key, columns).unionByName(_narrow(later, LATER, key, columns)), "snapshots")
    by_key = run_ranks(rows, ["key_text", "side"], [F.col("content"), F.col("row")])
    carried = ["key", "content", "row", *d]
    met = _both(by_key, "key_text", {c: f"old_{c}" for c in carried}, {c: f"new_{c}" for c in carried} | {"row_sha": "row_sha"})
    met = stash(met.drop("key_text", "rank"), "keys")
    in_both = F.col(f"in_{EARLIER}").isNotNull() & F.col(f"in_{LATER}").isNotNull()
    changed = F.concat_ws(",", *[F.when(~F.col(f"old_{x}").eqNullSafe(F.col(f"new_{x}")), F.lit(c)) for x, c in zip(d, columns, strict=True)])
    sha = F.lower(F.hex("row_sha")).alias("row_sha256")
    paired = met.filter(in_both).select(F.col("new_key").alias("key"), F.col("old_key"), changed.alias("changed"), sha)
    paired = paired.select("key", "old_key", F.when(F.col("changed") == "", "same").otherwise("update").alias("op"), "changed", "row_sha256")

    def alone(side: int, prefix: str) -> DataFrame:
        sha = F.col("row_sha") if side == LATER else F.lit(None).cast("binary")
        kept = [F.col(f"{prefix}_{c}").alias(c) for c in ("key", "content", "row")]
        return met.filter(F.col(f"in_{1 - side}").isNull()).select(F.lit(side).alias("side"), *kept, sha.alias("row_sha"))

    left = alone(EARLIER, "old").unionByName(alone(LATER, "new"))
    side, value = F.col("side"), F.col("key")
    directed = [F.when(side == EARLIER, value).asc(), F.when(side == LATER, value).desc(), F.col("row").asc()]
    by_content = _both(run_ranks(left, ["content", "side"], directed), "content", {"key": "old_key"}, {"key": "new_key", "row_sha": "row_sha"})
    op = F.when(F.col(f"in_{EARLIER}").isNull(), "insert").when(F.col(f"in_{LATER}").isNull(), "delete").otherwise("rekey")
    newest = F.when(F.col(f"in_{LATER}").isNull(), F.col("old_key")).otherwise(F.col("new_key"))
    return paired.unionByName(by_content.select(newest.alias("key"), "old_key", op.alias("op"), F.lit("").alias("changed"), sha))


def later_documents(docs: DataFrame) -> DataFrame:
    """The later snapshot of ``documents`` that op13 compares with: what happens to a row follows from its id's checksum."""
    docs = pick(docs, "doc_id", "text", "lang", "source")
    turn = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)), F.lit(-1))
    key, other = F.col("doc_id"), F.lit(-1) - F.col("doc_id")
    keys = F.when(turn == 0, F.array().cast("array<bigint>")).when(turn.isin(3, 4), F.array(other)).when(turn == 5, F.array(key, other)).otherwise(F.array(key))
    text = F.when(turn == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text"))
    lang = F.when(turn == 2, F.col("source")).otherwise(F.col("lang"))
    source = F.when(turn == 2, F.col("lang")).when(turn != 4, F.col("source"))
    return docs.select(F.explode(keys).alias("doc_id"), text.alias("text"), lang.alias("lang"), source.alias("source"))


#: crc32 by a table that a rule makes; checksums of ids, then both snapshots and their pairs
SNAPSHOT_SQL = """
WITH RECURSIVE bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), step + 1 FROM bits WHERE step < 8
), tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
turns AS MATERIALIZED (
  SELECT doc_id AS key, text, lang, source,
    CASE WHEN doc_id IS NULL THEN -1 ELSE xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) % 10 END AS turn
  FROM documents, tab
), later AS MATERIALIZED (
  SELECT CASE WHEN turn IN (3, 4) THEN -1 - key ELSE key END AS key,
    CASE WHEN turn = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
    CASE WHEN turn = 2 THEN source ELSE lang END AS lang,
    CASE WHEN turn = 2 THEN lang WHEN turn = 4 THEN NULL ELSE source END AS source
  FROM turns WHERE turn <> 0
  UNION ALL
  SELECT -1 - key, text, lang, source FROM turns WHERE turn = 5
), digested AS MATERIALIZED (
  SELECT *, sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) AS row_sha256 FROM later
), pairs AS (
  SELECT n.key, o.key AS old_key,
    concat_ws(',', CASE WHEN o.text IS DISTINCT FROM n.text THEN 'text' END, CASE WHEN o.lang IS DISTINCT FROM n.lang THEN 'lang' END,
      CASE WHEN o.source IS DISTINCT FROM n.source THEN 'source' END) AS changed, row_sha256
  FROM turns o JOIN digested n ON o.key = n.key
), old_left AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY key) AS rank FROM turns o
  WHERE NOT EXISTS (SELECT 1 FROM later n WHERE n.key = o.key)
), new_left AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY key DESC) AS rank FROM digested n
  WHERE NOT EXISTS (SELECT 1 FROM turns o WHERE n.key = o.key)
), rekeyed AS (
  SELECT n.key, o.key AS old_key, n.row_sha256 FROM old_left o JOIN new_left n
  ON o.rank = n.rank AND o.text IS NOT DISTINCT FROM n.text AND o.lang IS NOT DISTINCT FROM n.lang AND o.source IS NOT DISTINCT FROM n.source
)
SELECT key, old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, row_sha256 FROM pairs
UNION ALL SELECT key, old_key, 'rekey', '', row_sha256 FROM rekeyed
UNION ALL SELECT key, key, 'delete', '', NULL FROM old_left WHERE key NOT IN (SELECT old_key FROM rekeyed)
UNION ALL SELECT key, NULL, 'insert', '', row_sha256 FROM new_left WHERE key NOT IN (SELECT key FROM rekeyed)
"""
