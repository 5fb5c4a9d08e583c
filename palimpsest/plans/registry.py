"""All queries over the engine's operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import edit, geometry, text
from palimpsest.functions.constants import EUR_TO_USD, FALLBACK, FORMULAIC, HOURLY_EUR, PRICING, REGIONS, SELF_HOSTED, SUBSET_SIZES
from palimpsest.operators import analysis, cost, curation, inference, layout, report, samples, scoring
from palimpsest.plans import views as v
from palimpsest.plans.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Sums of floats depend on their order: six decimals are compared."""
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- scoring -----------------------------------------------------------------------------------------------------------

STATS = ["cer_mean", "cer_median", "cer_std", "lev_mean", "exact_pct"]
STATS_SQL = """count(*) AS n, round(avg(cer), 6) AS cer_mean, round(median(cer), 6) AS cer_median, round(coalesce(stddev_samp(cer), 0.0), 6) AS cer_std,
    round(avg(levenshtein), 6) AS lev_mean, round(avg(exact_match) * 100, 6) AS exact_pct"""


@query("j1_p2_collect_pairs", f"WITH {v.PAIRS_SQL} SELECT subfolder, stem, prediction, reference FROM pairs")
def _(spark, sf):
    return scoring.collect_pairs(*v.raw_pairs(spark, sf))[0]


@query("p3_outlier_pairs", f"WITH {v.PAIRS_SQL} SELECT subfolder, stem FROM normal_pairs WHERE prediction <> '' AND reference <> '' AND length(prediction)::DOUBLE / greatest(length(reference), 1) > 1.01")
def _(spark, sf):
    return scoring.collect_pairs(*v.raw_pairs(spark, sf), ratio=1.01)[1].select("subfolder", "stem")


@query("p1_normalize", f"SELECT doc_id, md5({v.normalize_sql('text')}) AS digest FROM (SELECT doc_id, replace(replace(text, ',', '...'), ' e', ' ~~e~~  ') AS text FROM documents)")
def _(spark, sf):
    marked = F.replace(F.replace("text", F.lit(","), F.lit("...")), F.lit(" e"), F.lit(" ~~e~~  "))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize(marked)).alias("digest"))


@query("a1_a4_item_metrics", f"WITH {v.ITEMS_SQL} SELECT subfolder, filename, round(cer, 6) AS cer, levenshtein, exact_match FROM items")
def _(spark, sf):
    return r6(scoring.item_metrics(v.pairs(spark, sf)).drop("wer"), "cer")


# words have no SQL: DuckDB's levenshtein counts bytes, and a whole text has more words than there are bytes
@query("a2_item_word_rates")
def _(spark, sf):
    return r6(scoring.item_metrics(v.pairs(spark, sf)).select("subfolder", "filename", "wer"), "wer")


@query("a5_by_subfolder", f"WITH {v.ITEMS_SQL} SELECT subfolder, {STATS_SQL} FROM items GROUP BY subfolder")
def _(spark, sf):
    return r6(scoring.by_group(scoring.item_metrics(v.pairs(spark, sf)), ("cer",)), *STATS)


@query("a5_a6_metrics_report", f"WITH {v.ITEMS_SQL} SELECT subfolder, CAST(grouping(subfolder) AS INTEGER) AS is_total, {STATS_SQL} FROM items GROUP BY GROUPING SETS ((subfolder), ())")
def _(spark, sf):
    return r6(scoring.report(scoring.item_metrics(v.pairs(spark, sf)), ("cer",)), *STATS)


@query("a5_a6_word_report")
def _(spark, sf):
    return r6(scoring.report(scoring.item_metrics(v.pairs(spark, sf)), ("wer",)), "wer_mean", "wer_median", "lev_mean", "exact_pct")


@query("a7_corpus_rates", f"WITH {v.ITEMS_SQL} SELECT count(*) AS n, round(sum(e)::DOUBLE / sum(c), 6) AS cer_micro FROM raw_items")
def _(spark, sf):
    return r6(scoring.corpus_rates(v.pairs(spark, sf)).drop("wer_micro"), "cer_micro")


@query("a7_corpus_word_rates")
def _(spark, sf):
    return r6(scoring.corpus_rates(v.pairs(spark, sf)).drop("cer_micro"), "wer_micro")


@query("a8_item_rates_unclipped", f"WITH {v.ITEMS_SQL} SELECT subfolder, filename, round(e::DOUBLE / c, 6) AS cer FROM raw_items")
def _(spark, sf):
    return r6(scoring.item_metrics(v.pairs(spark, sf), clip=False).select("subfolder", "filename", "cer"), "cer")


@query(
    "a9_evaluate_sources",
    f"""WITH {v.ITEMS_SQL}, losses AS (SELECT * FROM (VALUES ('en', 0.5::DOUBLE), ('fr', 0.25::DOUBLE), ('de', NULL)) t(source, loss)),
  by_source AS (SELECT subfolder AS source, count(*) AS n, sum(e)::DOUBLE / sum(c) AS cer_micro FROM raw_items GROUP BY 1),
  lost AS (SELECT b.*, loss FROM by_source b LEFT JOIN losses USING (source))
SELECT source, n, round(cer_micro, 6) AS cer_micro, loss FROM lost
UNION ALL SELECT 'ALL', (SELECT count(*) FROM raw_items), (SELECT round(sum(e)::DOUBLE / sum(c), 6) FROM raw_items), (SELECT round(sum(loss * n) / sum(n), 6) FROM lost)""",
)
def _(spark, sf):
    losses = spark.createDataFrame([("en", 0.5), ("fr", 0.25), ("de", None)], "source string, loss double")
    return r6(scoring.evaluate_sources(v.pairs(spark, sf).withColumnRenamed("subfolder", "source"), losses, ("cer",)).drop("wer_micro"), "cer_micro", "loss")


@query("d3_nested_report")
def _(spark, sf):
    return scoring.nested_report(scoring.item_metrics(v.pairs(spark, sf)))


# --- error analysis ----------------------------------------------------------------------------------------------------


def aligned(spark, sf):
    return analysis.aligned(v.pairs(spark, sf))


@query("a10_character_confusion")
def _(spark, sf):
    return analysis.character_confusion(aligned(spark, sf))


@query("c1_edit_totals", f"WITH {v.ITEMS_SQL} SELECT CAST(sum(e) AS BIGINT) AS edits FROM raw_items")
def _(spark, sf):
    return analysis.edit_totals(aligned(spark, sf)).select((F.col("substitutions") + F.col("insertions") + F.col("deletions")).alias("edits"))


@query("a11_entity_rates")
def _(spark, sf):
    return r6(analysis.entity_rates(aligned(spark, sf)), "cer")


WORDS_SQL = r"list_filter(regexp_split_to_array(reference, '\s+'), lambda w: w <> '')"


@query(
    "a11_entity_counts",
    f"""WITH {v.PAIRS_SQL}, w AS (SELECT translate(unnest({WORDS_SQL}), 'óñÓíÑÍÊéèêçÈÉÇöäüÖÜÄß', 'aaaaaaaaaaaaaaaaaaaa_') AS word FROM pairs)
SELECT 'numbers' AS entity, CAST(sum(len(regexp_extract_all(word, '\\b\\d+\\b'))) AS BIGINT) AS n FROM w
UNION ALL SELECT 'proper_nouns', CAST(sum(len(regexp_extract_all(word, '\\b[A-Za-z]{{3,}}\\b'))) AS BIGINT) FROM w
UNION ALL SELECT 'baseline', (SELECT count(*) FROM pairs)""",
)
def _(spark, sf):
    return analysis.entity_rates(aligned(spark, sf)).filter("entity <> 'dates'").select("entity", "n")


@query("a12_formulaic_rates")
def _(spark, sf):
    return r6(analysis.formulaic_rates(aligned(spark, sf)), "cer")


FORMULAIC_SQL = "(" + "|".join(FORMULAIC).replace("'", "''") + ")"


@query(
    "p15_formulaic_lines",
    f"""WITH {v.PAIRS_SQL}, lines AS (SELECT unnest(string_split(replace(reference, ' of ', ' fils de '), chr(10))) AS line FROM pairs)
SELECT CASE WHEN regexp_matches(line, '(?i){FORMULAIC_SQL}') THEN 'formulaic' ELSE 'free_text' END AS kind, count(*) AS n FROM lines GROUP BY 1""",
)
def _(spark, sf):
    lines = v.pairs(spark, sf).select(F.explode(F.split(F.replace("reference", F.lit(" of "), F.lit(" fils de ")), "\n")).alias("line"))
    return lines.groupBy(F.when(text.is_formulaic(F.col("line")), "formulaic").otherwise("free_text").alias("kind")).agg(F.count("*").alias("n"))


@query("a13_space_apostrophe")
def _(spark, sf):
    return analysis.space_apostrophe_totals(analysis.space_apostrophe(aligned(spark, sf)))


@query("t3_space_examples")
def _(spark, sf):
    return analysis.first_examples(analysis.space_apostrophe(aligned(spark, sf)))


@query(
    "a14_truncation",
    rf"""WITH {v.SPELT_SQL}, lines AS (
  SELECT unnest(string_split(reference, chr(10))) AS r, unnest(range(1, len(string_split(reference, chr(10))) + 1)) AS k, string_split(prediction, chr(10)) AS p FROM spelt
), both_lines AS (SELECT {v._strip_sql('r')} AS r, {v._strip_sql("coalesce(p[k], '')")} AS h FROM lines), long AS (SELECT * FROM both_lines WHERE length(r) >= 15), cut AS (
  SELECT right(r, 10) AS rt, right(h, 10) AS ht, left(r, length(r) - 10) AS rh, CASE WHEN length(h) >= 10 THEN left(h, length(h) - 10) ELSE '' END AS hh FROM long)
SELECT round(sum(levenshtein(rt, ht))::DOUBLE / sum(length(rt)), 6) AS tail_cer, count(*) AS tail_n, round(sum(levenshtein(rh, hh))::DOUBLE / sum(length(rh)), 6) AS head_cer, count_if(length(rh) > 0)::BIGINT AS head_n FROM cut""",
)
def _(spark, sf):
    return r6(analysis.truncation(v.pairs(spark, sf)), "tail_cer", "head_cer")


BUCKET_SQL = "CASE WHEN w BETWEEN 1 AND 3 THEN '1-3' WHEN w BETWEEN 4 AND 10 THEN '4-10' WHEN w BETWEEN 11 AND 25 THEN '11-25' WHEN w BETWEEN 26 AND 50 THEN '26-50' ELSE '51+' END"


@query(
    "a15_length_buckets",
    f"""WITH {v.SPELT_SQL}, b AS (SELECT subfolder AS s, len({WORDS_SQL}) AS w, {v.distance_sql('reference', 'prediction')} AS e, length(reference) AS c FROM spelt), g AS (SELECT {BUCKET_SQL} AS b, s, e, c FROM b)
SELECT CASE WHEN grouping(b) = 1 THEN 'ALL' ELSE b END AS bucket, CASE WHEN grouping(s) = 1 THEN 'ALL' ELSE s END AS subfolder, round(sum(e)::DOUBLE / sum(c), 6) AS cer, count(*) AS n
FROM g GROUP BY GROUPING SETS ((b, s), (b), (s))""",
)
def _(spark, sf):
    return r6(analysis.length_buckets(v.pairs(spark, sf)), "cer")


@query("a16_hallucinations")
def _(spark, sf):
    return analysis.hallucination_totals(analysis.hallucinations(aligned(spark, sf)))


@query("t2_longest_hallucinations")
def _(spark, sf):
    return analysis.longest(analysis.hallucinations(aligned(spark, sf)))


@query(
    "t1_top_words",
    f"""WITH {v.PAIRS_SQL}, w AS (SELECT unnest({WORDS_SQL}) AS word, stem FROM pairs)
SELECT word, count(*) AS n, min(stem) AS first_at FROM w GROUP BY word ORDER BY n DESC, first_at, word LIMIT 1""",
)
def _(spark, sf):
    return report.top_frequent(v.pairs(spark, sf).select("stem", F.explode(text.words(F.col("reference"))).alias("word")), "word", "stem", 1)


# --- layout ------------------------------------------------------------------------------------------------------------


@query("j11_best_match", f"WITH {v.BEST_SQL} SELECT image, cls, pid, gid, round(iou, 6) AS iou FROM best")
def _(spark, sf):
    return r6(layout.best_matches(v.truth_boxes(spark, sf), v.found_boxes(spark, sf)).drop("conf"), "iou")


COUNTS_SQL = f"""{v.BEST_SQL}, hits AS (SELECT image, cls, count(*) AS n_pred, count(DISTINCT CASE WHEN iou >= 0.5 THEN gid END) AS tp FROM best GROUP BY 1, 2),
there AS (SELECT image, cls, count(*) AS n_true FROM truth GROUP BY 1, 2), counts AS (
  SELECT cls, CAST(sum(coalesce(tp, 0)) AS BIGINT) AS tp, CAST(sum(coalesce(n_pred, 0) - coalesce(tp, 0)) AS BIGINT) AS fp, CAST(sum(coalesce(n_true, 0) - coalesce(tp, 0)) AS BIGINT) AS fn
  FROM there FULL JOIN hits USING (image, cls) GROUP BY cls)"""


@query("w3_match_counts", f"WITH {COUNTS_SQL} SELECT cls, tp, fp, fn FROM counts")
def _(spark, sf):
    return layout.match_counts(v.truth_boxes(spark, sf), v.found_boxes(spark, sf))


@query(
    "a17_detection_rates",
    f"""WITH {COUNTS_SQL}, sums AS (SELECT cls, CAST(grouping(cls) AS INTEGER) AS is_total, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM counts GROUP BY ROLLUP (cls)),
pr AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM sums)
SELECT cls, is_total, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM pr""",
)
def _(spark, sf):
    return r6(layout.rates(layout.match_counts(v.truth_boxes(spark, sf), v.found_boxes(spark, sf))), "precision", "recall", "f1")


@query(
    "w3_labelled_matches",
    f"""WITH {v.BEST_SQL}, good AS (SELECT *, coalesce(iou >= 0.5, false) AS good FROM best)
SELECT image, cls, pid, CAST(good AND row_number() OVER (PARTITION BY image, cls, gid, good ORDER BY conf DESC, pid) = 1 AS INTEGER) AS is_tp FROM good""",
)
def _(spark, sf):
    return layout.labelled_matches(v.truth_boxes(spark, sf), v.found_boxes(spark, sf))


@query(
    "j12_suppression",
    f"""WITH RECURSIVE {v.BOXES_SQL}, seqd AS (SELECT image, bid AS seq, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM found), ordered AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY seq) AS k FROM seqd),
fold AS (
  SELECT image, 1 AS k, [{{'seq': seq, 'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM ordered WHERE k = 1
  UNION ALL
  SELECT f.image, f.k + 1, CASE WHEN len(list_filter(f.kept, lambda g: greatest(least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x), 0) * greatest(least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y), 0)
      / (p.w * p.h + g.w * g.h - greatest(least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x), 0) * greatest(least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y), 0)) > 0.5)) > 0
    THEN f.kept ELSE list_append(f.kept, {{'seq': p.seq, 'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h}}) END
  FROM fold f JOIN ordered p ON p.image = f.image AND p.k = f.k + 1
), last AS (SELECT image, arg_max(kept, k) AS kept FROM fold GROUP BY image)
SELECT image, b.seq, b.x, b.y, b.w, b.h FROM (SELECT image, unnest(kept) AS b FROM last)""",
)
def _(spark, sf):
    return layout.suppress(v.found_boxes(spark, sf).withColumnRenamed("bid", "seq"))


@query(
    "j14_p9_predictions",
    f"""WITH {v.BOXES_SQL}, names AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(REGIONS))}) t(class_id, label))
SELECT image, bid AS seq, class_id, label, round(conf, 4)::DOUBLE AS confidence, CAST(trunc(x - w / 2.0) AS INTEGER) AS x, CAST(trunc(y - h / 2.0) AS INTEGER) AS y, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height
FROM found JOIN names ON cls * 4 = class_id""",
)
def _(spark, sf):
    d = v.found_boxes(spark, sf).select("image", F.col("bid").alias("seq"), (F.col("cls") * 4).cast("int").alias("class_id"), F.col("conf").alias("confidence"), F.col("x").alias("cx"), F.col("y").alias("cy"), "w", "h")
    return layout.predictions(d, layout.region_classes(spark))


CLAMP = "greatest(0.0, least(1.0, {}))"


@query(
    "p10_sk9_label_rows",
    f"""WITH {v.BOXES_SQL} SELECT image, bid AS seq, cls, CAST(round({CLAMP.format('(x + w / 2.0) / 1000.0')} * 1e6) AS BIGINT) AS cx, CAST(round({CLAMP.format('(y + h / 2.0) / 1300.0')} * 1e6) AS BIGINT) AS cy,
  CAST(round({CLAMP.format('w / 1000.0')} * 1e6) AS BIGINT) AS w, CAST(round({CLAMP.format('h / 1300.0')} * 1e6) AS BIGINT) AS h FROM truth""",
)
def _(spark, sf):
    rows = layout.label_rows(v.truth_boxes(spark, sf).withColumnRenamed("bid", "seq").withColumn("image_width", F.lit(1000)).withColumn("image_height", F.lit(1300)))
    parts = F.split("line", " ")
    return rows.select("image", "seq", parts[0].cast("long").alias("cls"), *[F.round(parts[i + 1].cast("double") * 1e6).cast("long").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))])


@query(
    "p11_sc9_label_corners",
    f"""WITH {v.BOXES_SQL} SELECT image, bid AS seq, cls, round((x / 1000.0 - w / 2000.0) * 1000, 3)::DOUBLE AS x1, round((y / 1000.0 - h / 2000.0) * 1300, 3)::DOUBLE AS y1,
  round((x / 1000.0 + w / 2000.0) * 1000, 3)::DOUBLE AS x2, round((y / 1000.0 + h / 2000.0) * 1300, 3)::DOUBLE AS y2 FROM truth""",
)
def _(spark, sf):
    from palimpsest.sources.labels import parse_label_line

    unit = lambda c: F.col(c).cast("double") / 1000
    lines = v.truth_boxes(spark, sf).select("image", F.col("bid").alias("seq"), F.format_string("%d %.6f %.6f %.6f %.6f", "cls", unit("x"), unit("y"), unit("w"), unit("h")).alias("value"))
    parsed = lines.select("image", "seq", parse_label_line(F.col("value")).alias("p")).select("image", "seq", "p.*")
    out = parsed.select("image", "seq", F.col("cls").cast("long").alias("cls"), *geometry.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(1000.0), F.lit(1300.0)))
    return out.withColumns({c: F.round(c, 3) for c in ("x1", "y1", "x2", "y2")})


@query(
    "sk9_label_files",
    f"""WITH {v.BOXES_SQL} SELECT image, count(*) AS n_lines FROM truth GROUP BY image""",
)
def _(spark, sf):
    rows = layout.label_rows(v.truth_boxes(spark, sf).withColumnRenamed("bid", "seq").withColumn("image_width", F.lit(1000)).withColumn("image_height", F.lit(1300)))
    return layout.label_files(rows).select("image", F.size(F.split("content", "\n")).cast("long").alias("n_lines"))


@query(
    "p12_prefilled",
    f"""WITH {v.BOXES_SQL}, names AS (SELECT * FROM (VALUES (0, 'Title'), (1, 'En-tête')) t(class_id, label)) SELECT image, bid, cls, label FROM truth JOIN names ON cls = class_id WHERE w - 100 >= 15 AND h - 60 >= 15""",
)
def _(spark, sf):
    small = v.truth_boxes(spark, sf).withColumn("w", F.col("w") - 100).withColumn("h", F.col("h") - 60)
    return layout.prefilled(small, layout.region_classes(spark).filter("class_id < 2")).select("image", "bid", "cls", "label")


@query(
    "iou_xywh",
    f"""WITH {v.BOXES_SQL} SELECT p.image, p.bid AS a, g.bid AS b, round({v.SHARED_SQL}::DOUBLE / (p.w * p.h + g.w * g.h - {v.SHARED_SQL}), 6) AS iou FROM truth p JOIN truth g ON p.image = g.image AND p.bid < g.bid""",
)
def _(spark, sf):
    b = v.truth_boxes(spark, sf)
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")])
    a, c = b.select("image", F.col("bid").alias("a"), box.alias("p")), b.select("image", F.col("bid").alias("b"), box.alias("g"))
    return a.join(c, "image").filter("a < b").select("image", "a", "b", F.round(geometry.iou_xywh(F.col("p"), F.col("g")), 6).alias("iou"))


@query("sk7_crop_metadata")
def _(spark, sf):
    boxes = v.found_boxes(spark, sf).withColumnRenamed("bid", "seq").withColumn("label", F.concat(F.lit("class"), "cls"))
    return layout.crop_metadata(boxes).select("image", F.to_json("metadata").alias("metadata"))


@query("sk10_dataset_splits", f"WITH {v.CROPS_SQL}, n AS (SELECT count_if(split = 'dev') AS dev, count_if(split = 'test') AS test FROM crops) SELECT 'train' AS train, CASE WHEN dev > 0 THEN 'dev' WHEN test > 0 THEN 'test' ELSE 'train' END AS val, CASE WHEN test > 0 THEN 'test' WHEN dev > 0 THEN 'dev' ELSE 'train' END AS test FROM n")
def _(spark, sf):
    return layout.dataset_splits(v.crops(spark, sf).groupBy("split").agg(F.count("*").alias("n")))


@query(
    "a22_boxes_by_image",
    f"WITH {v.BOXES_SQL} SELECT image, count(*)::INTEGER AS n_regions, array_to_string(list(CAST(bid AS VARCHAR) ORDER BY bid), ',') AS ids FROM truth GROUP BY image",
)
def _(spark, sf):
    got = report.collected(v.truth_boxes(spark, sf), "image", "bid", "cls", "x", "y", "w", "h", name="regions")
    return got.select("image", F.size("regions").alias("n_regions"), F.array_join(F.transform("regions", lambda r: r["bid"].cast("string")), ",").alias("ids"))


# --- curation ----------------------------------------------------------------------------------------------------------


@query("p6_page_key", f"WITH {v.CROPS_SQL} SELECT filename, page FROM crops")
def _(spark, sf):
    return v.crops(spark, sf).select("filename", "page")


@query("x1_weighted_split", f"WITH {v.CROPS_SQL} SELECT DISTINCT page, {v.split_sql('page')} AS split FROM crops")
def _(spark, sf):
    return v.crops(spark, sf).select("page", curation.weighted_split(F.col("page")).alias("split")).distinct()


@query(
    "j8_sticky_split",
    f"""WITH {v.CROPS_SQL}, old AS (SELECT page, arg_min('old-' || split, filename) AS old FROM crops WHERE doc_id % 5 = 0 GROUP BY page)
SELECT filename, coalesce(old, {v.split_sql('c.page')}) AS split FROM crops c LEFT JOIN old ON c.page = old.page""",
)
def _(spark, sf):
    crops = v.crops(spark, sf)
    old = crops.filter("doc_id % 5 = 0").select("filename", F.concat(F.lit("old-"), "split").alias("split"))
    return curation.assign_splits(crops.drop("page", "split"), old).select("filename", "split")


DUPED_SQL = f"{v.CROPS_SQL}, duped AS (SELECT subfolder, 'f' || CASE WHEN doc_id % 7 = 0 THEN doc_id // 50 ELSE doc_id // 2 END || '_' || doc_id % 3 || '.jpg' AS filename, split, path, doc_id FROM crops)"
FIRST_SQL = f"{DUPED_SQL}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subfolder, filename ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END, path) AS k FROM duped) WHERE k = 1)"


def duped(spark, sf):
    """Pages of two crops, and for one in fifty documents a page of more, with file names that repeat."""
    page = F.when(F.col("doc_id") % 7 == 0, F.floor(F.col("doc_id") / 50)).otherwise(F.floor(F.col("doc_id") / 2))
    name = F.concat(F.lit("f"), page.cast("string"), F.lit("_"), (F.col("doc_id") % 3).cast("string"), F.lit(".jpg"))
    return v.crops(spark, sf).select("subfolder", name.alias("filename"), "split", "path", "doc_id")


@query("w4_first_wins", f"WITH {FIRST_SQL} SELECT subfolder, filename, split, doc_id FROM first")
def _(spark, sf):
    return curation.first_wins(duped(spark, sf)).select("subfolder", "filename", "split", "doc_id")


PAGED_SQL = f"{FIRST_SQL}, one AS (SELECT *, regexp_replace(regexp_replace(filename, '\\.jpg$', ''), '_[0-9]+$', '') AS page FROM first)"
# each page to the split with the largest need left; of pages of one size the first by hash are train's, then test's, then dev's
REGROUP_SQL = f"""{PAGED_SQL}, pages AS (SELECT page, count(*) AS n FROM one GROUP BY page), ordered AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5(page || '|42'), page) AS k, sum(n) OVER () AS total FROM pages),
fold AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS train, 0::BIGINT AS test, 0::BIGINT AS dev, NULL::BIGINT AS n, NULL::VARCHAR AS split
  UNION ALL
  SELECT k, train + CASE WHEN split = 'train' THEN n ELSE 0 END, test + CASE WHEN split = 'test' THEN n ELSE 0 END, dev + CASE WHEN split = 'dev' THEN n ELSE 0 END, n, split FROM (
    SELECT o.k, f.train, f.test, f.dev, o.n, CASE WHEN 7 * total - 10 * f.train >= greatest(2 * total - 10 * f.test, total - 10 * f.dev) THEN 'train' WHEN 2 * total - 10 * f.test >= total - 10 * f.dev THEN 'test' ELSE 'dev' END AS split
    FROM fold f JOIN ordered o ON o.k = f.k + 1)
), shares AS (SELECT n, count_if(split = 'train') AS train, count_if(split = 'test') AS test FROM fold WHERE k > 0 GROUP BY n),
assigned AS (
  SELECT page, n, CASE WHEN r <= train THEN 'train' WHEN r <= train + test THEN 'test' ELSE 'dev' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY md5(page || '|42'), page) AS r FROM pages) JOIN shares USING (n))"""


def regrouped(spark, sf):
    return curation.first_wins(duped(spark, sf)).withColumn("page", text.page_key(F.col("filename")))


@query("x4_regroup", f"WITH RECURSIVE {REGROUP_SQL} SELECT page, n, split FROM assigned")
def _(spark, sf):
    return curation.regroup(regrouped(spark, sf))


@query("a19_split_counts", f"WITH RECURSIVE {REGROUP_SQL} SELECT split, CAST(sum(n) AS BIGINT) AS n, round(sum(n) * 100.0 / (SELECT sum(n) FROM assigned), 6)::DOUBLE AS pct FROM assigned GROUP BY split")
def _(spark, sf):
    crops = regrouped(spark, sf)
    return r6(curation.split_counts(curation.moved(crops, curation.regroup(crops))), "pct")


@query("sk14_moved", f"WITH RECURSIVE {REGROUP_SQL} SELECT o.split, a.split AS new_split, count(*) AS n, CAST(sum(CASE WHEN o.split <> a.split THEN 1 ELSE 0 END) AS BIGINT) AS moved FROM one o JOIN assigned a ON o.page = a.page GROUP BY 1, 2")
def _(spark, sf):
    crops = regrouped(spark, sf)
    return curation.moved(crops, curation.regroup(crops)).groupBy("split", "new_split").agg(F.count("*").alias("n"), F.count_if("moved").alias("moved"))


@query("j2_sc6_crops_with_labels", f"WITH {v.CROPS_SQL} SELECT filename, coalesce(CASE WHEN doc_id % 3 = 0 THEN text END, '') AS text FROM crops")
def _(spark, sf):
    crops = v.crops(spark, sf).withColumn("stem", text.stem(F.col("filename")))
    labels = crops.filter("doc_id % 3 = 0 and text is not null").select("split", "subfolder", "stem", "text")
    return curation.with_labels(crops.drop("text"), labels).select("filename", "text")


@query(
    "j3_sc7_first_image",
    f"""WITH {v.CROPS_SQL}, stems AS (SELECT *, regexp_replace(filename, '\\.jpg$', '') AS stem FROM crops), images AS (
  SELECT subfolder, stem, ext, stem || ext AS path FROM stems, (VALUES ('.png'), ('.jpg'), ('.jpeg'), ('.gif')) e(ext)
  WHERE (doc_id % 2 = 0 AND ext = '.png') OR (doc_id % 3 = 0 AND ext = '.jpg') OR (doc_id % 5 = 0 AND ext = '.jpeg') OR ext = '.gif'),
best AS (SELECT subfolder, stem, arg_min(path, CASE ext WHEN '.jpg' THEN 1 WHEN '.jpeg' THEN 2 ELSE 3 END) AS image FROM images WHERE ext <> '.gif' GROUP BY 1, 2)
SELECT s.subfolder, s.stem, image FROM stems s JOIN best b ON s.subfolder = b.subfolder AND s.stem = b.stem WHERE trim(text) <> ''""",
)
def _(spark, sf):
    crops = v.crops(spark, sf).withColumn("stem", text.stem(F.col("filename")))
    d = F.col("doc_id")
    exts = F.array_compact(F.array(F.when(d % 2 == 0, F.lit(".png")), F.when(d % 3 == 0, F.lit(".jpg")), F.when(d % 5 == 0, F.lit(".jpeg")), F.lit(".gif")))
    images = crops.select("subfolder", "stem", F.explode(exts).alias("ext")).withColumn("path", F.concat("stem", "ext"))
    return curation.first_image(crops.select("subfolder", "stem", "text"), images).select("subfolder", "stem", "image")


@query("j4_not_annotated", f"WITH {v.CROPS_SQL} SELECT filename, subfolder FROM crops c WHERE NOT EXISTS (SELECT 1 FROM crops a WHERE a.text <> '' AND a.doc_id % 2 = 0 AND a.filename = c.filename AND a.subfolder = c.subfolder)")
def _(spark, sf):
    crops = v.crops(spark, sf)
    annotations = crops.select("filename", "subfolder", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("text"))
    return curation.not_annotated(crops.select("filename", "subfolder"), annotations)


@query("j5_sk4_not_done", f"WITH {v.CROPS_SQL} SELECT path FROM crops WHERE NOT (doc_id % 4 = 0 AND doc_id % 8 > 0)")
def _(spark, sf):
    crops = v.crops(spark, sf)
    done = crops.filter("doc_id % 4 = 0").select("path", (F.col("doc_id") % 8).alias("size"))
    return curation.not_done(crops.select("path"), done, size="size")


@query("j6_with_source", f"WITH {v.BOXES_SQL} SELECT image AS filename, count(*)::INTEGER AS n FROM truth WHERE image % 2 = 0 GROUP BY image")
def _(spark, sf):
    boxes = v.truth_boxes(spark, sf)
    annotations = report.collected(boxes, "image", "bid", "cls", name="boxes").withColumnRenamed("image", "filename")
    images = boxes.filter("image % 2 = 0").select(F.col("image").alias("filename"))
    return curation.with_source(annotations, images).select("filename", F.size("boxes").alias("n"))


@query("j7_upsert", f"WITH {v.CROPS_SQL} SELECT filename, subfolder, CASE WHEN doc_id % 3 = 0 THEN 'new ' || doc_id ELSE coalesce(text, '') END AS text FROM crops WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _(spark, sf):
    crops = v.crops(spark, sf)
    old = crops.filter("doc_id % 2 = 0").select("filename", "subfolder", F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    new = crops.filter("doc_id % 3 = 0").select("filename", "subfolder", F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("text"), "doc_id")
    return curation.upsert(old, new, ["filename", "subfolder"], "doc_id").drop("doc_id")


@query("j9_line_pairs", f"WITH {v.PAIRS_SQL}, lines AS (SELECT stem, unnest(string_split(reference, chr(10))) AS r, unnest(range(1, len(string_split(reference, chr(10))) + 1)) AS k, string_split(prediction, chr(10)) AS p FROM pairs) SELECT stem, CAST(k - 1 AS INTEGER) AS k, r, coalesce(p[k], '') AS h FROM lines")
def _(spark, sf):
    df = v.pairs(spark, sf).select("stem", F.split("prediction", "\n").alias("p"), F.posexplode(F.split("reference", "\n")).alias("k", "r"))
    return df.select("stem", "k", "r", F.coalesce(F.get("p", F.col("k")), F.lit("")).alias("h"))


@query(
    "w1_p5_capped_dedup",
    """WITH t AS (SELECT doc_id, text FROM documents), long AS (SELECT * FROM t WHERE length(text) >= 3), k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM long)
SELECT doc_id FROM k WHERE k <= (SELECT greatest(1, floor(count(*) * 0.003)) FROM long)""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return curation.capped(rows, "doc_id", share=0.003).select("doc_id")


def take_sql(rows: str, stratum: str, key: str, tie: str, sizes: str) -> str:
    return f"""strat AS (SELECT *, {stratum} AS stratum FROM {rows}), ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {key}, {tie}) AS rn FROM strat),
counts AS (SELECT stratum, count(*) AS n FROM strat GROUP BY 1), sizes AS (SELECT unnest({sizes})::BIGINT AS size),
q AS (SELECT size, stratum, n, least(size, sum(n) OVER (PARTITION BY size)) AS want, sum(n) OVER (PARTITION BY size) AS total FROM counts, sizes),
k AS (SELECT *, least(CAST(round_even(want * n::DOUBLE / total, 0) AS BIGINT), n) AS k FROM q), p AS (
  SELECT *, sum(k) OVER (PARTITION BY size) AS all_k, coalesce(sum(k) OVER w, 0) AS before_k, coalesce(sum(n - k) OVER w, 0) AS before_rest FROM k WINDOW w AS (PARTITION BY size ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
take AS (SELECT size, stratum, greatest(0, least(k, want - before_k)) + greatest(0, least(n - k, want - all_k - before_rest)) AS take FROM p)"""


@query(
    "w2_w5_nested_subsets",
    f"WITH {v.CROPS_SQL}, {take_sql('crops', 'subfolder', 'md5(filename || ' + repr('|42') + ')', 'filename', str(SUBSET_SIZES))} SELECT size, filename FROM ranked r JOIN take t ON r.stratum = t.stratum WHERE rn <= take",
)
def _(spark, sf):
    crops = v.crops(spark, sf)
    return curation.stratified(crops, F.col("subfolder"), curation.shuffle_key(F.col("filename")), SUBSET_SIZES, "filename").select("size", "filename")


@query(
    "u2_nested_check",
    "SELECT count(*) = 0 AS is_subset FROM documents d WHERE doc_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.doc_id = d.doc_id)",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return curation.is_subset(docs.filter("doc_id % 4 = 0"), docs.filter("doc_id % 2 = 0"), "doc_id")


@query(
    "x5_parish_century",
    f"WITH {v.CORPUS_SQL}, {take_sql('corpus', f'coalesce(parish, ' + repr('unk') + f') || ' + repr('|') + f' || {v.CENTURY_SQL}', 'md5(record_id || ' + repr('|42') + ')', 'record_id', '[500]')} SELECT record_id FROM ranked r JOIN take t ON r.stratum = t.stratum WHERE rn <= take",
)
def _(spark, sf):
    return curation.parish_century(v.corpus(spark, sf), 500).select("record_id")


@query("x2_x6_exact_split", "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) <= floor(count(*) OVER () * 0.2) AS is_test FROM documents")
def _(spark, sf):
    return curation.exact_split(table(spark, sf, "documents").select("doc_id"), 0.2, "doc_id")


@query(
    "x3_complete_splits",
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) <= floor(count(*) OVER () * 0.2) AS t FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|43'), doc_id) <= floor(count(*) OVER () * 0.5) AS u FROM a WHERE t)
SELECT doc_id, 'train' AS split FROM a WHERE NOT t UNION ALL SELECT doc_id, CASE WHEN u THEN 'test' ELSE 'validation' END FROM b""",
)
def _(spark, sf):
    return curation.complete_splits(table(spark, sf, "documents").select("doc_id", F.lit("train").alias("split")), "doc_id")


@query("x7_random_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 50")
def _(spark, sf):
    return curation.random_sample(table(spark, sf, "documents").select("doc_id"), 50, "doc_id")


@query("u1_combine", "SELECT 'census' AS source, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 2 UNION ALL SELECT 'private', 'train', count(*) FROM documents WHERE lang = 'fr'")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    a = docs.filter("lang = 'en'").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"))
    b = docs.filter("lang = 'fr'").select("doc_id", "text", F.lit("train").alias("split"))
    return curation.combine(("census", a), ("private", b)).groupBy("source", "split").agg(F.count("*").alias("n"))


@query("u3_augmented", f"WITH {v.CROPS_SQL} SELECT path FROM crops UNION ALL SELECT regexp_replace(path, '([^/]+)$', 'lower_contrast_\\1') FROM crops")
def _(spark, sf):
    return curation.augmented(v.crops(spark, sf).select("path"))


@query("u4_missing_splits", f"WITH {v.CROPS_SQL}, s AS (SELECT DISTINCT subfolder AS source, split FROM crops WHERE subfolder <> 'es' OR split <> 'dev') SELECT source, n.split FROM (SELECT DISTINCT source FROM s) a, (VALUES ('train'), ('test'), ('dev')) n(split) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source = a.source AND s.split = n.split)")
def _(spark, sf):
    rows = v.crops(spark, sf).filter("subfolder <> 'es' or split <> 'dev'").withColumnRenamed("subfolder", "source")
    return curation.missing_splits(rows, spark.createDataFrame([("train",), ("test",), ("dev",)], "split string"))


# --- corpus rows, text projections ---------------------------------------------------------------------------------------


@query("sc12_p7_corpus_rows", f"WITH {v.CORPUS_SQL} SELECT record_id, url, text, coalesce(parish, 'unk') AS parish, {v.CENTURY_SQL} AS bucket FROM corpus WHERE contains(coalesce(url, ''), 'archive.example') AND trim(text) <> ''")
def _(spark, sf):
    from palimpsest.sources.tables import corpus_rows

    return corpus_rows(v.corpus(spark, sf), "archive.example")


@query("a20_frequency", f"WITH {v.CORPUS_SQL}, b AS (SELECT {v.CENTURY_SQL} AS bucket FROM corpus) SELECT bucket, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY bucket")
def _(spark, sf):
    return r6(report.frequency(v.corpus(spark, sf), text.century(F.col("start_date")), "bucket"), "share")


@query("a20_label_distribution", f"WITH {v.BOXES_SQL} SELECT cls, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM truth), 6) AS share FROM truth GROUP BY cls")
def _(spark, sf):
    rows = report.collected(v.truth_boxes(spark, sf), "image", "bid", "cls", name="objects")
    return r6(report.frequency(rows.select(F.explode("objects.cls").alias("cls")), "cls", "cls"), "share")


@query("a21_annotated_counts", f"WITH {v.CROPS_SQL} SELECT split, count(*) AS images, count_if(coalesce(text, '') <> '')::BIGINT AS annotated FROM crops GROUP BY split")
def _(spark, sf):
    return report.annotated_counts(v.crops(spark, sf))


@query("p4_clean_census", "SELECT doc_id, md5(clean) AS digest, length(clean)::BIGINT AS len, '' AS source_image FROM (SELECT doc_id, regexp_replace(translate(text, 'aeo', '   '), '\\s+', ' ', 'g') AS clean FROM documents) WHERE length(clean) > 2")
def _(spark, sf):
    from palimpsest.sources.tables import census

    marked = F.translate("text", "aeo", "¤/¬")
    return census(table(spark, sf, "documents").select("doc_id", marked.alias("text"))).select("doc_id", F.md5("text").alias("digest"), "len", "source_image")


@query("p8_subfolder", f"WITH {v.CROPS_SQL} SELECT path, subfolder FROM crops")
def _(spark, sf):
    paths = v.crops(spark, sf).select(F.concat_ws("/", "split", "subfolder", F.lit("images"), "filename").alias("p"), "path", "doc_id")
    return paths.select("path", text.subfolder(F.when(F.col("doc_id") % 2 == 0, F.col("p")).otherwise(F.col("path"))).alias("subfolder"))


@query("p13_class_ids", f"WITH {v.BOXES_SQL} SELECT image, bid, cls::INTEGER AS class_id FROM truth")
def _(spark, sf):
    from palimpsest.sources.labels import parse_named_line

    names = F.create_map(*[F.lit(x) for i, n in enumerate(REGIONS) for x in (n, i)])
    label = F.element_at(F.array(*map(F.lit, REGIONS)), (F.col("cls") + 1).cast("int"))
    line = F.concat_ws(" ", F.when(F.col("bid") % 2 == 0, label).otherwise(F.col("cls").cast("string")), "x", "y", "w", "h")
    return v.truth_boxes(spark, sf).select("image", "bid", parse_named_line(line, names)["class_id"].alias("class_id"))


@query("p14_word_buckets", f"WITH {v.PAIRS_SQL}, b AS (SELECT len({WORDS_SQL}) AS w FROM pairs) SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM b GROUP BY 1")
def _(spark, sf):
    counted = analysis.settled(v.pairs(spark, sf), F.size(text.words(F.col("reference"))).alias("words"))  # looked at for each bucket
    return counted.groupBy(text.length_bucket(F.col("words")).alias("bucket")).agg(F.count("*").alias("n"))


@query("p18_without_thinking", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN ltrim(text, chr(10) || ' ') ELSE text END) AS digest FROM documents")
def _(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think>\nso\n</think>\n\n "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.without_thinking(raw)).alias("digest"))


@query("p19_thinking_tokens", f"WITH {v.USAGE_SQL} SELECT model, CAST(sum(greatest(coalesce(input_tokens + output_tokens, 0) - coalesce(thinking_tokens, 0) - input_tokens, 0)) AS BIGINT) AS n FROM usage GROUP BY model")
def _(spark, sf):
    u = v.usage(spark, sf)
    return u.groupBy("model").agg(F.sum(text.thinking_tokens(F.col("input_tokens") + F.col("output_tokens"), F.col("thinking_tokens"), F.col("input_tokens"))).alias("n"))


@query("p20_ner_prompt", "SELECT doc_id, md5('Extract: ' || replace(replace(text, '(', ''), ')', '') || chr(10) || 'A:') AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.render_prompt("Extract: {{text}}\nA:", F.col("text"))).alias("digest"))


@query("p21_mime_base64", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' ELSE 'image/jpeg' END AS mime, md5(base64(encode(text))) AS digest FROM documents")
def _(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, (".PNG", ".webp", ".jpg", ".tiff"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", text.mime(F.concat(F.lit("a/b"), ext)).alias("mime"), F.md5(text.base64(F.col("text"))).alias("digest"))


MODELS = [*PRICING, *SELF_HOSTED, "o1-preview", "O3"]
CALLS_SQL = "SELECT ({models})[event_id % {n} + 1] AS model FROM events"


def calls(spark: SparkSession, sf: str, models: list[str]) -> DataFrame:
    """The model that each event calls."""
    at = (F.col("event_id") % len(models) + 1).cast("int")
    return table(spark, sf, "events").select(F.element_at(F.array(*map(F.lit, models)), at).alias("model"))


@query(
    "p22_p23_model_predicates",
    f"""WITH m AS ({CALLS_SQL.format(models=MODELS, n=len(MODELS))})
SELECT model, regexp_matches(lower(model), '^(gpt-5|o1|o3)') AS is_new, model IN ({', '.join(repr(m) for m in SELF_HOSTED)}) AS is_self_hosted, count(*) AS calls FROM m GROUP BY model""",
)
def _(spark, sf):
    marked = calls(spark, sf, MODELS).select("model", text.is_new_model(F.col("model")).alias("is_new"), F.col("model").isin(SELF_HOSTED).alias("is_self_hosted"))
    return marked.groupBy("model", "is_new", "is_self_hosted").agg(F.count("*").alias("calls"))


@query("p24_escape_html", "SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.escape_html(F.col("text"))).alias("digest"))


@query("p26_padding", "SELECT p_partkey, whole // 2 AS pad_before, whole - whole // 2 AS pad_after FROM (SELECT p_partkey, CAST((((p_size + 1) // 2 - 1) * 2 + 5 - p_size) * 3 AS BIGINT) AS whole FROM part)")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *geometry.same_padding(F.col("p_size"), 5, 2, 3))


@query(
    "p25_palette",
    f"""WITH {v.BOXES_SQL}, hues AS (SELECT cls, count(*) AS boxes, 6.0 * cls / {len(REGIONS)} AS h, 0.95 AS v, 0.95 * (1 - 0.75) AS p FROM truth GROUP BY cls),
parts AS (SELECT *, 0.95 * (1 - 0.75 * (h - floor(h))) AS q, 0.95 * (1 - 0.75 * (1 - (h - floor(h)))) AS t FROM hues),
rgb AS (SELECT cls, boxes, CASE CAST(floor(h) AS INTEGER) WHEN 0 THEN [v, t, p] WHEN 1 THEN [q, v, p] WHEN 2 THEN [p, v, t] WHEN 3 THEN [p, q, v] WHEN 4 THEN [t, p, v] ELSE [v, p, q] END AS c FROM parts)
SELECT cls, '#' || array_to_string(list_transform(c, lambda x: printf('%02x', CAST(trunc(x * 255) AS INTEGER))), '') AS colour, boxes FROM rgb""",
)
def _(spark, sf):
    colours = F.element_at(F.array(*map(F.lit, geometry.palette(len(REGIONS)))), (F.col("cls") + 1).cast("int"))
    return v.truth_boxes(spark, sf).groupBy("cls", colours.alias("colour")).agg(F.count("*").alias("boxes"))


@query("p28_padded_labels", "WITH l AS (SELECT c_custkey, range(1, c_custkey % 9 + 1) AS ids FROM customer) SELECT c_custkey, array_to_string(list_transform(range(1, 7), lambda i: coalesce(ids[i], -100)), ',') AS labels, array_to_string(list_transform(range(0, 6), lambda i: CASE WHEN i = 0 THEN 2 ELSE coalesce(ids[i], 0) END), ',') AS inputs FROM l")
def _(spark, sf):
    ids = F.when(F.col("c_custkey") % 9 > 0, F.sequence(F.lit(1), (F.col("c_custkey") % 9).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = table(spark, sf, "customer").select("c_custkey", samples.padded_labels(ids, 6).alias("l"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return df.select("c_custkey", joined(F.col("l")).alias("labels"), joined(samples.shifted_right(F.col("l"), 2)).alias("inputs"))


@query("p29_masked_prompt", "SELECT c_custkey, array_to_string(list_transform(range(0, 8), lambda i: CASE WHEN i < c_custkey % 5 OR i = 6 THEN -100 ELSE i END), ',') AS labels FROM customer")
def _(spark, sf):
    masked = samples.masked_prompt(F.sequence(F.lit(0), F.lit(7)), F.col("c_custkey") % 5, [6])
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.transform(masked, lambda x: x.cast("string")), ",").alias("labels"))


@query("p30_conversations", "SELECT conv_id, count(*)::INTEGER AS n_messages, md5(array_to_string(list(role || ':' || text ORDER BY turn, role, text), '|')) AS digest FROM conversations GROUP BY conv_id")
def _(spark, sf):
    told = samples.conversation(table(spark, sf, "conversations"))
    back = F.from_json("messages", "array<struct<role:string,content:string>>")
    return told.select("conv_id", "n_messages", F.md5(F.array_join(F.transform(back, lambda m: F.concat_ws(":", m["role"], m["content"])), "|")).alias("digest"))


@query("p30_chat")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", samples.chat("Transcribe.", F.col("text")).alias("messages"))


def _length_model():
    """Stands in for a model: it answers with the prompt's length."""
    return lambda prompt: '{"length": %d, "first": "%s"}' % (len(prompt), prompt[:7])


@query("m5_entities", "SELECT doc_id AS id, length(replace(replace(text, '(', ''), ')', '')) + 10 AS length, 'Read th' AS head FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    docs = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text")
    answers = inference.extract_entities(docs, "Read this {{text}}", "struct<length:bigint,first:string>", _length_model)
    return answers.select("id", F.col("entities.length").alias("length"), F.col("entities.first").alias("head"))


# --- cost and reports ----------------------------------------------------------------------------------------------------

PRICES_SQL = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in PRICING.items()) + ") t(model, input_price, output_price))"


@query(
    "a18_j13_usage_cost",
    f"""WITH {v.USAGE_SQL}, {PRICES_SQL}, sums AS (SELECT model, count(*) AS total_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(coalesce(thinking_tokens, 0)) AS BIGINT) AS thinking_tokens, sum(seconds) AS seconds FROM usage GROUP BY model)
SELECT s.model, total_calls, input_tokens, output_tokens, thinking_tokens, round(CASE WHEN s.model IN ({', '.join(repr(m) for m in SELF_HOSTED)}) THEN seconds / 3600.0 * {HOURLY_EUR} * {EUR_TO_USD}
  ELSE input_tokens / 1e6 * coalesce(input_price, 0) + (output_tokens + thinking_tokens) / 1e6 * coalesce(output_price, 0) END, 6) AS cost FROM sums s LEFT JOIN prices p ON s.model = p.model""",
)
def _(spark, sf):
    return r6(cost.usage_cost(v.usage(spark, sf), cost.pricing(spark)), "cost")


@query(
    "j17_fallback_chains",
    f"""WITH RECURSIVE edges AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in FALLBACK.items())}) t(model, next)), chain AS (
  SELECT DISTINCT model, 0 AS step, model AS candidate, [model] AS tried FROM edges UNION ALL
  SELECT c.model, c.step + 1, e.next, list_append(c.tried, e.next) FROM chain c JOIN edges e ON c.candidate = e.model WHERE NOT list_contains(c.tried, e.next)),
called AS (SELECT model, count(*) AS calls FROM ({CALLS_SQL.format(models=MODELS, n=len(MODELS))}) GROUP BY model)
SELECT model, step, candidate, calls FROM chain JOIN called USING (model)""",
)
def _(spark, sf):
    """The models that calls fall back to, with how many calls may."""
    called = calls(spark, sf, MODELS).groupBy("model").agg(F.count("*").alias("calls"))
    return cost.fallback_chains(cost.fallback(spark)).join(called, "model")


@query(
    "j16_learning_curve",
    f"""WITH {v.ITEMS_SQL}, m AS (SELECT subfolder AS key, 60 AS size, CASE WHEN CAST(filename AS BIGINT) % 2 = 0 THEN 'dev' ELSE 'test' END AS split, avg(cer) AS c FROM items WHERE subfolder <> 'fr' OR CAST(filename AS BIGINT) % 2 = 0 GROUP BY ALL),
g AS (SELECT key, size FROM (VALUES ('en'), ('fr'), ('xx')) k(key), (VALUES (60), (120)) s(size))
SELECT g.key, g.size, coalesce((SELECT printf('%.4f', c) FROM m WHERE m.key = g.key AND m.size = g.size AND split = 'dev'), '-') AS dev, coalesce((SELECT printf('%.4f', c) FROM m WHERE m.key = g.key AND m.size = g.size AND split = 'test'), '-') AS test FROM g""",
)
def _(spark, sf):
    odd = F.col("filename").cast("long") % 2
    items = scoring.item_metrics(v.pairs(spark, sf)).filter((F.col("subfolder") != "fr") | (odd == 0))
    m = items.groupBy(F.col("subfolder").alias("key"), F.lit(60).alias("size"), F.when(odd == 0, "dev").otherwise("test").alias("split")).agg(F.avg("cer").alias("cer_mean"))
    one = lambda values, schema: spark.createDataFrame([(x,) for x in values], schema)
    return report.curve(report.grid(one(["en", "fr", "xx"], "key string"), one([60, 120], "size int"), one(["dev", "test"], "split string")), m)


@query("c2_word_levenshtein")
def _(spark, sf):
    words = lambda c: scoring.split_words(F.col(c))
    df = v.pairs(spark, sf).withColumn("r", words("reference")).withColumn("h", words("prediction"))
    return df.select("stem", edit.word_levenshtein(F.col("r"), F.col("h")).alias("edits"))


# --- sources, sinks and model seams over tables ------------------------------------------------------------------------


@query("sc16_sidecars", f"WITH {v.CROPS_SQL} SELECT filename, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id WHEN doc_id % 3 = 0 THEN 'b' || doc_id ELSE '' END AS text FROM crops")
def _(spark, sf):
    from palimpsest.sources.files import sidecars

    crops = v.crops(spark, sf).withColumn("stem", text.stem(F.col("filename")))
    side = lambda k, name: crops.filter(F.col("doc_id") % k == 0).select("subfolder", "stem", F.concat(F.lit(name), F.col("doc_id").cast("string")).alias("text"))
    return sidecars(crops.drop("text"), side(2, "a"), side(3, "b")).select("filename", "text")


@query("sk1_annotations_by_split", f"WITH {v.CROPS_SQL} SELECT coalesce(CASE WHEN split <> 'dev' THEN split END, 'train') AS split, count(*) AS n FROM crops GROUP BY 1")
def _(spark, sf):
    from palimpsest.sinks.files import with_default_split

    rows = v.crops(spark, sf).withColumn("split", F.when(F.col("split") != "dev", F.col("split")))
    return with_default_split(rows).groupBy("split").agg(F.count("*").alias("n"))


def results(spark, sf):
    return v.usage(spark, sf).select(F.col("model").alias("path"), "input_tokens", "output_tokens", F.when(F.col("input_tokens") % 7 == 0, "boom").alias("error"))


@query("sk5_run_summary", f"WITH {v.USAGE_SQL} SELECT count(*) AS images, count_if(input_tokens % 7 <> 0)::BIGINT AS succeeded, count_if(input_tokens % 7 = 0)::BIGINT AS failed, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage")
def _(spark, sf):
    from palimpsest.sinks.files import run_summary

    return run_summary(results(spark, sf))[0]


@query("sk5_failures", f"WITH {v.USAGE_SQL} SELECT model AS path, 'boom' AS error FROM usage WHERE input_tokens % 7 = 0")
def _(spark, sf):
    from palimpsest.sinks.files import run_summary

    return run_summary(results(spark, sf))[1]


@query("sk6_prediction_rows", f"WITH {v.BOXES_SQL} SELECT image AS filename, count(*)::INTEGER AS n_regions, array_to_string(list(CAST(trunc(x - w / 2.0) AS INTEGER)::VARCHAR ORDER BY bid), ',') AS xs FROM found GROUP BY image")
def _(spark, sf):
    from palimpsest.sinks.files import prediction_rows

    d = v.found_boxes(spark, sf).select("image", F.col("bid").alias("seq"), F.col("cls").cast("int").alias("class_id"), F.col("conf").alias("confidence"), F.col("x").alias("cx"), F.col("y").alias("cy"), "w", "h")
    rows = prediction_rows(layout.predictions(d, layout.region_classes(spark)))
    return rows.select("filename", "n_regions", F.array_join(F.transform("regions", lambda r: r["x"].cast("string")), ",").alias("xs"))


def echo_client():
    """Answers with the image's size; the first model of a chain says nothing of images of even size."""

    def call(model: str, content: bytes) -> tuple[str, int, int]:
        return ("" if model == "gemini-2.5-pro" and len(content) % 2 == 0 else str(len(content)), len(content), 1)

    return call


def as_images(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))


@query(
    "m3_transcribe",
    """WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS path, octet_length(encode(text)) AS n FROM documents)
SELECT path, CASE WHEN n % 2 = 0 THEN 'gemini-2.0-flash' ELSE 'gemini-2.5-pro' END AS model, n::VARCHAR AS text, CAST(CASE WHEN n % 2 = 0 THEN 4 * n ELSE n END AS BIGINT) AS input_tokens, CAST(CASE WHEN n % 2 = 0 THEN 4 ELSE 1 END AS BIGINT) AS output_tokens, NULL::VARCHAR AS error FROM c""",
)
def _(spark, sf):
    from palimpsest.operators.inference import transcribe

    return transcribe(as_images(spark, sf), "gemini-2.5-pro", echo_client)


@query("m2_transcribe_lines", "SELECT CAST(doc_id AS VARCHAR) AS path, octet_length(encode(text))::VARCHAR AS text FROM documents")
def _(spark, sf):
    from palimpsest.operators.inference import transcribe_lines

    return transcribe_lines(as_images(spark, sf), lambda: lambda batch: [str(len(c)) for c in batch])


@query("m1_detect", "SELECT CAST(doc_id AS VARCHAR) AS image, s.k::INTEGER AS seq, (octet_length(encode(text)) % 8)::INTEGER AS class_id FROM documents, (SELECT unnest([0, 1]) AS k) s")
def _(spark, sf):
    from palimpsest.operators.inference import detect

    found = detect(as_images(spark, sf), lambda: lambda c: [(len(c) % 8, 0.5, 1.0, 1.0, 2.0, 2.0)] * 2)
    return found.select("image", "seq", "class_id")
