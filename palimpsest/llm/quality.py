"""Quality rules: base counts, and divergence of a document's character classes and common words from those of its language.

Only DataFrame functions. Word windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.base import GAP, pick, text_of

# Frequent words of four languages, in thousandths of running prose.
COMMON = {
    "de": {
        "der": 62, "die": 55, "und": 35, "in": 20, "den": 16, "von": 12, "zu": 11, "das": 11, "mit": 10, "des": 9, "sich": 8, "auf": 8, "ist": 8, "für": 7,
        "im": 7, "dem": 7, "nicht": 7, "ein": 6, "eine": 6, "als": 5, "auch": 5, "es": 5, "an": 5, "werden": 4,
    },
    "en": {
        "the": 62, "of": 33, "and": 28, "to": 25, "a": 22, "in": 20, "is": 11, "that": 10, "it": 9, "for": 9, "was": 9, "on": 7, "with": 7, "as": 7,
        "be": 6, "by": 5, "this": 5, "are": 5, "at": 5, "from": 4, "have": 4, "not": 5, "or": 4, "which": 3,
    },
    "es": {
        "de": 62, "la": 38, "que": 30, "el": 28, "en": 26, "y": 25, "los": 17, "se": 13, "del": 12, "las": 11, "un": 10, "por": 9, "con": 9, "no": 9,
        "una": 8, "su": 8, "para": 7, "es": 7, "al": 6, "lo": 6, "como": 5, "más": 4, "o": 4, "pero": 3,
    },
    "fr": {
        "de": 60, "la": 35, "le": 27, "et": 24, "les": 19, "des": 18, "en": 16, "un": 13, "du": 12, "une": 11, "que": 10, "est": 10, "dans": 9, "pour": 8,
        "qui": 8, "par": 7, "il": 7, "au": 7, "sur": 6, "pas": 5, "avec": 5, "ce": 5, "se": 5, "plus": 4,
    },
}
CLASSES = ["lower", "upper", "digit", "space", "symbol", "other"]
# Thousandths of characters by class (a-z, A-Z, 0-9, white space, ASCII symbols, all others) in running prose.
PROSE = {"de": [755, 35, 5, 155, 22, 28], "en": [790, 20, 5, 165, 20, 0], "es": [725, 15, 5, 165, 22, 68], "fr": [710, 15, 5, 165, 25, 80]}
BINS = 24
#: largest Jensen-Shannon distances (base 2, 0 to 1) at which a document is kept, and the lengths from which each counts. A
#: sample of n words is off by chance by about one over the root of n, so the limit for words has a part of that size.
MOST_CHARS, LEAST_CHARS = 0.2, 200
MOST_WORDS, CHANCE, LEAST_WORDS = 0.2, 1.5, 50
UPPER, LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = r"""[.,;:!?"'()]+"""
#: up to so many repeated windows each place is looked up in their list; beyond, places are sorted by window
FEW = 24


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def covered(places: Column) -> Column:
    """How many words the 3-word windows at sorted ``places`` cover."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n")), lambda acc: acc["n"])


def settled(df: DataFrame) -> DataFrame:
    """The same rows by way of a generator: the optimizer doesn't merge what follows with what made them, and lambdas that
    read these columns don't work them out again for each element."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, row, lang`` with the counts and histograms of each row of ``docs(doc_id, text, lang)``; no shuffle."""
    df = pick(docs, "doc_id", "text", "lang").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text_of().alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    common = F.lit(None).cast("array<string>")
    for lang, words in COMMON.items():
        common = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(common)
    bare = F.split(F.regexp_replace(F.translate("text", UPPER, LETTERS), MARKS, ""), GAP)
    # what lambdas read is a column of an earlier step, else it would be worked out for each element
    df = df.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))).withColumn("common", common)
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rare = F.regexp_replace("text", "[a-z]+", "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id", "row", "lang", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        windows.alias("windows"), rare.alias("rare"), F.length("text").alias("chars"), lines.alias("lines"), "common",
        F.when(F.col("common").isNotNull(), F.array_join(F.filter(bare, lambda w: F.array_contains("common", w)), "  ")).otherwise(F.lit("")).alias("hits"),
    )
    df = settled(df.withColumn("hits", F.concat(F.lit(" "), "hits", F.lit(" "))))
    df = df.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array("windows")))
    repeated = F.when(
        F.col("ordered").isNotNull(),
        F.array_distinct(F.filter("ordered", lambda w, i: w == F.get("ordered", i - 1))),
    ).otherwise(F.array().cast("array<bigint>"))
    rare_chars = F.length("rare")
    classes = [
        F.col("chars") - rare_chars,
        _length_without(F.col("rare"), "[^A-Z]+"),
        _length_without(F.col("rare"), "[^0-9]+"),
        _length_without(F.col("rare"), r"[^\x20\x09-\x0D]+"),
        _length_without(F.col("rare"), r"[^!-/:-@\[-`{-~]+"),
    ]


    def times(word: Column) -> Column:
        """How often a word is among those found, which stand between spaces."""
        return F.floor((F.octet_length("hits") - F.octet_length(F.replace("hits", F.concat(F.lit(" "), word, F.lit(" ")), F.lit("")))) / (F.octet_length(word) + 2)).cast("long")

    df = df.withColumn("repeated", repeated).select(
        "doc_id", "row", "lang", "n_words", "word_chars", "windows", "repeated", "chars", "common",
        _length_without(F.col("rare"), r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array(*[c.cast("long") for c in classes]).alias("classes"),
        F.when(F.col("common").isNotNull(), F.transform("common", times)).otherwise(F.array_repeat(F.lit(0).cast("long"), BINS)).alias("hits"),
    )
    by_window = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    df = df.withColumn("by_window", F.when(F.size("repeated") > FEW, by_window))
    sorted_places = F.sort_array(
        F.transform(
            F.filter("by_window", lambda x, k: (x["w"] == F.get("by_window", k - 1)["w"]) | (x["w"] == F.get("by_window", k + 1)["w"])),
            lambda x: x["i"],
        )
    )
    looked_up = F.filter(F.transform("windows", lambda w, i: F.when(F.array_contains("repeated", w), i)), lambda i: i.isNotNull())
    places = F.when(F.size("repeated") == 0, F.array().cast("array<int>")).when(F.size("repeated") <= FEW, looked_up).otherwise(sorted_places)
    df = df.withColumn("places", places)
    counted = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    heard = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(
        "doc_id", "row", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered(F.col("places")).cast("long").alias("n_repeat_words"), F.col("chars").cast("long").alias("chars"),
        F.concat("classes", F.array(F.col("chars") - counted)).alias("classes"), F.concat("hits", F.array(F.col("n_words") - heard)).alias("hits"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""

    def against(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda x, y: against(x, y) + against(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2))


def shares(counts: Column) -> Column:
    total = F.greatest(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    return F.transform(counts, lambda x: x / total)


def reference(counts: list[int]) -> Column:
    """Thousandths as shares."""
    return F.array(*[F.lit(x / 1000) for x in counts])


def listed(words: dict[str, int]) -> list[int]:
    return [*words.values(), 1000 - sum(words.values())]


def quality_rules(docs: DataFrame) -> DataFrame:
    """The base counts of each row of ``docs(doc_id, text, lang)``, ``base_failed``, ``kept`` and the two distances; no shuffle.

    The references are fixed tables of running prose, so a document's verdict hangs on no other document. A distance counts
    only from ``LEAST_CHARS`` characters or ``LEAST_WORDS`` words on. Documents of a language without tables (or of none)
    are held against the nearest of all character tables, and not by words. Words are looked up without case and marks.
    ``row`` tells apart unequal rows with one doc_id. A null or empty text has counts of 0 and fails the base. Repeated
    rows are judged each, texts whole however long, an empty table gives an empty one, and columns other than the three are
    left, also ones with clashing names.
    """
    counts = settled(base_counts(docs))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = settled(counts.withColumn("class_shares", shares(F.col("classes"))).withColumn("hit_shares", shares(F.col("hits"))))
    lang = F.col("lang")
    nearest = F.least(*[distance(F.col("class_shares"), reference(PROSE[k])) for k in PROSE])
    by_class, by_word = nearest, F.lit(0.0)
    for k in PROSE:
        by_class = F.when(lang == k, distance(F.col("class_shares"), reference(PROSE[k]))).otherwise(by_class)
        by_word = F.when(lang == k, distance(F.col("hit_shares"), reference(listed(COMMON[k])))).otherwise(by_word)
    chars = F.when(F.col("chars") >= LEAST_CHARS, by_class).otherwise(F.lit(0.0))
    words = F.when(F.col("n_words") >= LEAST_WORDS, by_word).otherwise(F.lit(0.0))
    judged = counts.withColumn("class_distance", chars).withColumn("word_distance", words).withColumn("base_failed", failed)
    most_words = F.lit(MOST_WORDS) + F.lit(CHANCE) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    kept = ~F.col("base_failed") & (F.col("class_distance") <= MOST_CHARS) & (F.col("word_distance") <= most_words)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance", "row")


def _sql() -> str:
    """The same in DuckDB's SQL over the view ``documents``."""
    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in COMMON.items())

    def left(pattern: str, text: str = "rare") -> str:
        return f"length(regexp_replace({text}, '{pattern}', '', 'g'))"

    def share(name: str) -> str:
        return f"list_transform({name}, lambda x: x / greatest(list_sum({name}), 1.0)::DOUBLE)"

    def apart(p: str, thousandths: list[int]) -> str:
        def term(x: str, y: str) -> str:
            return f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"

        q = "[" + ", ".join(f"{x}::DOUBLE / 1000" for x in thousandths) + "]"
        return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {term('z[1]', 'z[2]')} + {term('z[2]', 'z[1]')})) / 2))"

    by_class = " ".join(f"WHEN '{k}' THEN {apart('ps', v)}" for k, v in PROSE.items())
    by_word = " ".join(f"WHEN '{k}' THEN {apart('ws', listed(v))}" for k, v in COMMON.items())
    nearest = ", ".join(apart("ps", v) for v in PROSE.values())
    marks = MARKS.replace("'", "''")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, regexp_replace(t, '[a-z]+', '', 'g') AS rare,
    regexp_extract_all(regexp_replace(translate(t, '{UPPER}', '{LETTERS}'), '{marks}', '', 'g'), '[^\x20\x09-\x0D]+') AS bare,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CASE lang {lists} END AS common
  FROM d
), windows AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), c AS (
  SELECT w.rid, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST({left('[\x20\x09-\x0D]+', 't')} AS BIGINT) AS word_chars,
    CAST({left('[^#*$%&|<>]+')} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS chars,
    [length(t) - length(rare), {left('[^A-Z]+')}, {left('[^0-9]+')}, {left('[^\x20\x09-\x0D]+')}, {left('[^!-/:-@\\[-`{-~]+')}] AS five,
    CASE WHEN common IS NULL THEN list_transform(range({BINS}), lambda x: 0) ELSE list_transform(common, lambda c: len(list_filter(bare, lambda x: x = c))) END AS hits
  FROM w LEFT JOIN covered USING (rid)
), h AS (
  SELECT *, list_append(five, chars - list_sum(five)) AS classes, list_append(hits, n_words - list_sum(hits)) AS all_hits FROM c
), p AS (
  SELECT *, {share('classes')} AS ps, {share('all_hits')} AS ws FROM h
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN chars >= {LEAST_CHARS} THEN CASE lang {by_class} ELSE least({nearest}) END ELSE 0 END AS class_distance,
    CASE WHEN n_words >= {LEAST_WORDS} THEN CASE lang {by_word} ELSE 0 END ELSE 0 END AS word_distance
  FROM p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND class_distance <= {MOST_CHARS} AND word_distance <= {MOST_WORDS}::DOUBLE + {CHANCE}::DOUBLE / sqrt(greatest(n_words, 1)::DOUBLE) AS kept
FROM judged
""".replace("\\\\", "\\").replace("[^!-/:-@\\[-`{-~]", "[^!-/:-@\\[-`{-~]")


QUALITY_SQL = _sql()
