"""The domain's tables, derived from the driver's, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.constants import OUTLIER_RATIO
from palimpsest.functions.text import page_key
from palimpsest.operators.curation import weighted_split
from palimpsest.operators.scoring import normalized, too_long
from palimpsest.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subfolder, stem, prediction, reference``: a whole text, and the same spoilt by the document's number."""
    df = spread(table(spark, sf_dir, "documents").select(F.col("lang").alias("subfolder"), F.col("doc_id").cast("string").alias("stem"), (F.col("doc_id") % 6).alias("m"), F.col("text").alias("t")))
    t = F.col("t")
    spoilt = (
        F.when(F.col("m") == 1, F.translate(t, "aeiou", "eaoiu"))
        .when(F.col("m") == 2, F.replace(t, F.lit(" the "), F.lit(" ")))
        .when(F.col("m") == 3, F.concat(F.substring(t, 1, 100), F.lit(" lorem ipsum dolor sit "), F.expr("substring(t, 101)")))
        .when(F.col("m") == 4, F.replace(t, F.lit(" "), F.lit("")))
        .when(F.col("m") == 5, F.expr("substring(t, 1, char_length(t) div 2)"))
        .otherwise(t)
    )
    return df.select("subfolder", "stem", spoilt.alias("prediction"), t.alias("reference"))


def raw_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and labels as two tables, to be joined."""
    df = _spoilt(spark, sf_dir)
    return df.drop("reference"), df.drop("prediction")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that count, from one scan: joining two halves of one table again would only add a shuffle."""
    return normalized(_spoilt(spark, sf_dir), lambda p: ~too_long(p, OUTLIER_RATIO))


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"


def normalize_sql(x: str) -> str:
    x = rf"regexp_replace({_strip_sql(x)}, '~~([^\n]*?)~~', '\1', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[.·]{{3,}}', '', 'g'), '[ \t]+', ' ', 'g')"
    return rf"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E]'), lambda s: {_strip_sql('s')}), lambda s: s <> ''), chr(10))"


RAW_PAIRS_SQL = r"""
raw_pairs AS (
  SELECT lang AS subfolder, CAST(doc_id AS VARCHAR) AS stem, text AS reference,
    CASE doc_id % 6 WHEN 1 THEN translate(text, 'aeiou', 'eaoiu') WHEN 2 THEN replace(text, ' the ', ' ')
      WHEN 3 THEN substr(text, 1, 100) || ' lorem ipsum dolor sit ' || substr(text, 101) WHEN 4 THEN replace(text, ' ', '') WHEN 5 THEN substr(text, 1, length(text) // 2) ELSE text END AS prediction
  FROM documents
)"""
PAIRS_SQL = f"""{RAW_PAIRS_SQL}, normal_pairs AS (
  SELECT subfolder, stem, {normalize_sql('prediction')} AS prediction, {normalize_sql('reference')} AS reference FROM raw_pairs
), pairs AS (
  SELECT * FROM normal_pairs WHERE prediction <> '' AND reference <> '' AND length(prediction)::DOUBLE / greatest(length(reference), 1) <= 10.0
)"""

# DuckDB's levenshtein counts bytes: letters beyond ASCII become control characters that no text has
LETTERS_SQL = """letters AS (
  SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS odd, array_to_string(list_transform(list_concat(range(1, 9), range(14, 28), [127]), lambda i: chr(i::INTEGER)), '') AS plain
  FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS c FROM documents)
)"""
SPELT_SQL = f"""{PAIRS_SQL}, {LETTERS_SQL}, spelt AS (
  SELECT subfolder, stem, translate(prediction, odd, plain) AS prediction, translate(reference, odd, plain) AS reference FROM pairs, letters
)"""


def distance_sql(r: str, h: str) -> str:
    return f"CASE WHEN {r} = {h} THEN 0 WHEN starts_with({r}, {h}) THEN length({r}) - length({h}) ELSE levenshtein({r}, {h}) END"


ITEMS_SQL = f"""{SPELT_SQL}, raw_items AS MATERIALIZED (
  SELECT subfolder, stem AS filename, {distance_sql('reference', 'prediction')} AS e, length(reference) AS c, prediction = reference AS same FROM spelt
), items AS (
  SELECT subfolder, filename, least(e::DOUBLE / c, 1.0) AS cer, CAST(e AS INTEGER) AS levenshtein, CAST(same AS DOUBLE) AS exact_match FROM raw_items
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, bid, cls, x, y, w, h`` of the truth, with the keys that spoil it."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("image"), F.row_number().over(order).cast("long").alias("bid"), (F.col("l_partkey") % 3).alias("cls"),
        (F.col("l_partkey") * 37 % 900).alias("x"), (F.col("l_suppkey") * 53 % 1200).alias("y"),
        (40 + 4 * F.col("l_quantity")).cast("long").alias("w"), (60 + F.col("l_quantity")).cast("long").alias("h"), "l_partkey", "l_suppkey",
    )


def truth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).drop("l_partkey", "l_suppkey")


def found_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = boxes(spark, sf_dir).filter("l_partkey % 11 <> 0")
    cls = F.when(F.col("l_partkey") % 13 == 0, (F.col("cls") + 1) % 3).otherwise(F.col("cls"))
    return df.select("image", "bid", cls.alias("cls"), (F.col("x") + F.col("l_partkey") % 7 * 6).alias("x"), (F.col("y") + F.col("l_suppkey") % 5 * 6).alias("y"), "w", "h", ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 1000 / 1000.0).alias("conf"))


BOXES_SQL = """
boxes AS (
  SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS bid,
    l_partkey % 3 AS cls, l_partkey * 37 % 900 AS x, l_suppkey * 53 % 1200 AS y, CAST(trunc(40 + 4 * l_quantity) AS BIGINT) AS w, CAST(trunc(60 + l_quantity) AS BIGINT) AS h, l_partkey, l_suppkey
  FROM lineitem
), truth AS (
  SELECT image, bid, cls, x, y, w, h FROM boxes
), found AS (
  SELECT image, bid, CASE WHEN l_partkey % 13 = 0 THEN (cls + 1) % 3 ELSE cls END AS cls, x + l_partkey % 7 * 6 AS x, y + l_suppkey % 5 * 6 AS y, w, h, (l_partkey * 7 + l_suppkey * 3) % 1000 / 1000.0 AS conf
  FROM boxes WHERE l_partkey % 11 <> 0
)"""
SHARED_SQL = "greatest(least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x), 0) * greatest(least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y), 0)"
BEST_SQL = f"""{BOXES_SQL}, overlapped AS (
  SELECT p.image, p.cls, p.bid AS pid, p.conf, g.bid AS gid, CASE WHEN g.bid IS NOT NULL THEN {SHARED_SQL}::DOUBLE / greatest(p.w * p.h + g.w * g.h - {SHARED_SQL}, 1e-6) END AS iou
  FROM found p LEFT JOIN truth g ON p.image = g.image AND p.cls = g.cls
), best AS (
  SELECT image, cls, pid, conf, gid, iou FROM (SELECT *, row_number() OVER (PARTITION BY image, cls, pid ORDER BY iou DESC NULLS LAST, gid) AS k FROM overlapped) WHERE k = 1
)"""


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crop for each document: its file, folder, page, split and label text (for documents with a label)."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has_label", F.lit(True))
    df = docs.join(labels, "doc_id", "left")
    filename = F.concat("source", F.lit("_"), F.lpad((F.col("doc_id") % 97).cast("string"), 4, "0"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    df = df.select(filename.alias("filename"), F.col("lang").alias("subfolder"), F.when(F.col("has_label"), F.col("text")).alias("text"), "doc_id")
    df = df.withColumn("page", page_key(F.col("filename"))).withColumn("split", weighted_split(F.concat("page", (F.col("doc_id") % 2).cast("string"))))
    return df.withColumn("path", F.concat_ws("/", "split", F.lit("images"), "subfolder", "filename"))


SPLIT_SQL = """CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < 0.9 THEN 'test' ELSE 'dev' END"""


def draw_sql(key: str, seed: int = 42) -> str:
    return f"(CAST(('0x' || substr(md5({key} || '|{seed}'), 1, 8)) AS BIGINT) / 4294967296.0)"


def split_sql(key: str, seed: int = 42) -> str:
    return SPLIT_SQL.format(u=draw_sql(key, seed))


CROPS_SQL = f"""
named AS (
  SELECT d.doc_id, source || '_' || lpad(CAST(d.doc_id % 97 AS VARCHAR), 4, '0') || '_' || d.doc_id || '.jpg' AS filename, lang AS subfolder,
    CASE WHEN l.doc_id IS NOT NULL THEN text END AS text
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
), paged AS (
  SELECT *, regexp_replace(regexp_replace(filename, '\\.jpg$', ''), '_[0-9]+$', '') AS page FROM named
), crops AS (
  SELECT *, split || '/images/' || subfolder || '/' || filename AS path FROM (SELECT *, {split_sql("page || CAST(doc_id % 2 AS VARCHAR)")} AS split FROM paged)
)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"click": "gpt-5", "view": "gemini-2.5-flash", "purchase": "mistral-large-latest", "error": "Qwen3.6-35B-A3B"}
    model = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")], F.concat(F.lit("unpriced-"), "event_type"))
    k = lambda n: F.floor(F.abs("value") * n).cast("long")
    return table(spark, sf_dir, "events").select(model.alias("model"), k(100).alias("input_tokens"), k(10).alias("output_tokens"), F.when(F.col("event_id") % 3 == 0, k(5)).alias("thinking_tokens"), F.lit(2.0).alias("seconds"))


USAGE_SQL = """
usage AS (
  SELECT CASE event_type WHEN 'click' THEN 'gpt-5' WHEN 'view' THEN 'gemini-2.5-flash' WHEN 'purchase' THEN 'mistral-large-latest' WHEN 'error' THEN 'Qwen3.6-35B-A3B' ELSE 'unpriced-' || event_type END AS model,
    CAST(floor(abs(value) * 100) AS BIGINT) AS input_tokens, CAST(floor(abs(value) * 10) AS BIGINT) AS output_tokens,
    CASE WHEN event_id % 3 = 0 THEN CAST(floor(abs(value) * 5) AS BIGINT) END AS thinking_tokens, 2.0::DOUBLE AS seconds
  FROM events
)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    start = F.when(F.col("o_orderkey") % 10 == 0, F.lit(0)).when(F.col("o_orderkey") % 10 == 1, None).otherwise(year - (F.col("o_orderkey") % 4) * 100)
    url = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("https://archive.example/"), F.col("o_orderkey")))
    text = F.when(F.col("o_orderkey") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit("act "), F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), url.alias("url"), text.alias("text"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("parish"), start.cast("string").alias("start_date"))


CORPUS_SQL = """
corpus AS (
  SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'https://archive.example/' || o_orderkey END AS url,
    CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE 'act ' || o_orderkey END AS text, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS parish,
    CAST(CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 10 = 1 THEN NULL ELSE year(o_orderdate) - (o_orderkey % 4) * 100 END AS VARCHAR) AS start_date
  FROM orders
)"""
CENTURY_SQL = "CASE WHEN TRY_CAST(start_date AS INTEGER) > 0 THEN CAST(TRY_CAST(start_date AS INTEGER) // 100 + 1 AS VARCHAR) ELSE 'unk' END"
