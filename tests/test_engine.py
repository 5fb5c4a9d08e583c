"""Golden rows and invariants of the engine's operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import edit, geometry, text
from palimpsest.functions.constants import PRICING, SPLIT_WEIGHTS
from palimpsest.operators import analysis, cost, curation, inference, layout, samples, scoring


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("x")).first()["x"]


def test_normalize(spark):
    cases = {" a ~~b~~  c\n\n d....e ": "a b c\nde", "": "", "  ": "", "é ü\x85x": "é\nü\nx", "a··b···c": "a··bc", "~~x\ny~~": "~~x\ny~~"}
    for raw, want in cases.items():
        assert one(spark, text.normalize(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [("REG22_VOL78_0261_0238_5.jpg", "REG22_VOL78_0261_0238"), ("0001_BOX04_ACT_850116_0029_005.jpg", "0001_BOX04_ACT_850116_0029"), ("000.jpg", "000"), ("a/b/p_1_2.x.png", "p_1_2.x"), ("p_7", "p")],
)
def test_page_key(spark, name, want):
    assert one(spark, text.page_key(F.col("t")), t=name) == want


def test_small_functions(spark):
    for year, want in {"1894": "19", "1900": "20", "0": "unk", "x": "unk", "-5": "unk"}.items():
        assert one(spark, text.century(F.col("t")), t=year) == want
    for n, want in {3: "1-3", 4: "4-10", 25: "11-25", 50: "26-50", 51: "51+", 10_000: "51+"}.items():
        assert one(spark, text.length_bucket(F.col("n")), n=n) == want
    assert one(spark, text.without_thinking(F.col("t")), t="<think>a</think>\n\n b</think>c") == "b</think>c"
    assert one(spark, text.mime(F.col("t")), t="x/a.WEBP") == "image/webp" and one(spark, text.mime(F.col("t")), t="a.b/c") == "image/jpeg"
    assert one(spark, text.subfolder(F.col("t")), t="a/images/x.jpg") == "a" and one(spark, text.subfolder(F.col("t")), t="x.jpg") == ""
    assert one(spark, text.is_formulaic(F.col("t")), t="NÉE À Paris") and not one(spark, text.is_formulaic(F.col("t")), t="rien")
    assert one(spark, F.size(text.entity_matches(F.col("t"), "dates")), t="le 3 août 1850 et 12 MAI 1851") == 2
    assert one(spark, F.size(text.entity_matches(F.col("t"), "proper_nouns", True)), t="Émile née ici Ab") == 1
    assert one(spark, text.thinking_tokens(F.col("a"), F.col("b"), F.lit(None)), a=10, b=4) == 6
    assert len(geometry.palette(8)) == 8 == len(set(geometry.palette(8)))


def test_word_levenshtein(spark):
    split = lambda c: F.split(c, " ")
    assert one(spark, edit.word_levenshtein(split(F.col("a")), split(F.col("b"))), a="the cat sat on the mat", b="the cat on a the mat mat") == 3
    assert one(spark, F.levenshtein(F.col("a"), F.col("b")), a="é", b="e") == 1


@pytest.mark.parametrize("seed", range(4))
def test_alignments_are_optimal_and_whole(spark, seed):
    rng = random.Random(seed)
    rows = [("".join(rng.choice("abé ") for _ in range(rng.randint(0, 14))), "".join(rng.choice("abé ") for _ in range(rng.randint(0, 14)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "r string, h string")
    chunks = edit.word_chunks(F.split("r", ""), F.split("h", ""))
    for x in df.filter("r <> '' and h <> ''").select("r", "h", chunks.alias("ops"), edit.char_edits(F.col("r"), F.col("h")).alias("edits"), F.levenshtein("r", "h").alias("d"), edit.char_distance(F.col("r"), F.col("h")).alias("mine")).collect():
        assert x["mine"] == sum(max(c["re"] - c["rs"], c["he"] - c["hs"]) for c in x["ops"] if c["op"] != "equal") == x["d"]
        assert sum(c["re"] - c["rs"] for c in x["ops"]) == len(x["r"]) and sum(c["he"] - c["hs"] for c in x["ops"]) == len(x["h"])
        assert all(x["r"][c["rs"] : c["re"]] == x["h"][c["hs"] : c["he"]] for c in x["ops"] if c["op"] == "equal")
        places = lambda ops: [tuple(c)[:5] for c in ops if c["op"] != "equal"]
        assert places(x["edits"]) == places(x["ops"])
        assert all((c["ref"], c["hyp"], c["before"]) == (x["r"][c["rs"] : c["re"]], x["h"][c["hs"] : c["he"]], x["r"][max(0, c["rs"] - 8) : c["rs"]]) for c in x["edits"])


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 5, 5), (50, 50, 5, 5), 0.0), ((0, 0, 100, 100), (25, 25, 50, 50), 0.25), ((0, 0, 10, 10), (10, 0, 10, 10), 0.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)],
)
def test_iou(spark, a, b, want):
    box = lambda v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, "xywh", strict=True)])
    assert one(spark, geometry.iou_xywh(box(a), box(b))) == pytest.approx(want)


PAIRS = [
    ("a", "1", "le chat est la", "le chat est la"), ("a", "2", "le  chien lorem ipsum dolor noir", "le chien noir"), ("b", "3", "l homme", "l'homme"),
    ("b", "4", "Le nomme Jean fils de Paul\nne le 3 mai 1850", "Le nommé Jean fils de Paul\nné le 3 mai 1850"), ("c", "5", "", "x"), ("c", "6", "y" * 500, "y"),
]


def scored(spark):
    p = spark.createDataFrame([(s, t, h) for s, t, h, _ in PAIRS], "subfolder string, stem string, prediction string")
    r = spark.createDataFrame([(s, t, r) for s, t, _, r in PAIRS] + [("z", "9", "alone")], "subfolder string, stem string, reference string")
    return scoring.collect_pairs(p, r)


def test_scoring(spark):
    pairs, outliers = scored(spark)
    assert {r["stem"] for r in pairs.collect()} == {"1", "2", "3", "4"} and [r["stem"] for r in outliers.collect()] == ["6"]
    items = {r["filename"]: r for r in scoring.item_metrics(pairs).collect()}
    assert items["1"]["cer"] == 0 and items["1"]["exact_match"] == 1 and items["2"]["wer"] == 1.0
    assert items["3"]["levenshtein"] == 1
    groups = {r["subfolder"]: r for r in scoring.by_group(scoring.item_metrics(pairs.filter("stem in ('1','3','4')"))).collect()}
    assert groups["a"]["cer_std"] == 0.0 and groups["a"]["n"] == 1
    assert scoring.report(scoring.item_metrics(pairs.limit(0))).count() == 0
    nested = json.loads(scoring.nested_report(scoring.item_metrics(pairs)).first()["report"])
    assert set(nested) == {"by_subfolder", "global"} and nested["global"]["n"] == 4


def test_analysis(spark):
    al = analysis.aligned(scored(spark)[0]).cache()
    found = analysis.hallucinations(al).collect()
    assert [(r["inserted_text"], r["n_words"]) for r in found] == [("lorem ipsum dolor", 3)]
    kinds = {(r["kind"], r["stem"]): r for r in analysis.space_apostrophe(al).collect()}
    assert kinds["apostrophe", "3"]["ref"] == "'" and kinds["split", "3"]["hyp"] == " "
    rates = {r["entity"]: r for r in analysis.entity_rates(al).collect()}
    assert rates["dates"]["n"] == 1 and rates["dates"]["cer"] == 0 and rates["numbers"]["n"] == 2
    lines = {r["kind"]: r["n"] for r in analysis.formulaic_rates(al).collect()}
    assert lines == {"formulaic": 1, "free_text": 4}
    confusion = {(r["op"], r["ref_char"], r["hyp_char"]): r["n"] for r in analysis.character_confusion(al).collect()}
    assert confusion["substitute", "é", "e"] == 2
    al.unpersist()


def greedy(truth, found, threshold):
    """Sequential matching: by confidence, each prediction takes its best truth box unless it is taken."""
    used, tp = set(), 0
    for _, box in sorted(found, key=lambda x: -x[0]):
        best = max(range(len(truth)), key=lambda i: (iou(box, truth[i]), -i), default=None)
        if best is not None and iou(box, truth[best]) >= threshold and best not in used:
            used.add(best)
            tp += 1
    return tp, len(found) - tp, len(truth) - tp


def iou(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h / max(a[2] * a[3] + b[2] * b[3] - w * h, 1e-6)


def test_matching_equals_greedy_loop(spark):
    rng = random.Random(3)
    rows_t, rows_f, want = [], [], [0, 0, 0]
    for image in range(40):
        box = lambda: (rng.randrange(40), rng.randrange(40), rng.randint(10, 30), rng.randint(10, 30))
        truth, found = [box() for _ in range(rng.randint(0, 6))], [(rng.random(), box()) for _ in range(rng.randint(0, 6))]
        rows_t += [(image, i, 0, *b) for i, b in enumerate(truth)]
        rows_f += [(image, i, 0, *b, c) for i, (c, b) in enumerate(found)]
        want = [a + b for a, b in zip(want, greedy(truth, found, 0.3), strict=True)]
    t = spark.createDataFrame(rows_t, "image long, bid long, cls int, x long, y long, w long, h long")
    f = spark.createDataFrame(rows_f, "image long, bid long, cls int, x long, y long, w long, h long, conf double")
    got = layout.match_counts(t, f, 0.3).first()
    assert [got["tp"], got["fp"], got["fn"]] == want
    assert layout.labelled_matches(t, f, 0.3).filter("is_tp = 1").count() == want[0]
    assert layout.rates(layout.match_counts(t.limit(0), f)).filter("is_total = 1").first()["f1"] == 0


def test_label_lines(spark):
    from palimpsest.sources.labels import parse_label_line, parse_named_line

    assert one(spark, parse_label_line(F.col("t"))["cls"], t=" 3 0.5 0.5 0.1 0.2 ") == 3 and one(spark, parse_label_line(F.col("t")), t="3 0.5") is None
    ids = F.create_map(F.lit("Plein Texte"), F.lit(4))
    assert one(spark, parse_named_line(F.col("t"), ids)["class_id"], t="Plein Texte 1 2 3 4") == 4


def test_regroup_keeps_pages_whole_and_is_idempotent(spark):
    rows = [(f"p{i}", f"p{i}_{k}.jpg", ["train", "test", "dev"][k % 3]) for i in range(30) for k in range(1 + i % 4)]
    crops = spark.createDataFrame(rows, "page string, filename string, split string")
    first = curation.moved(crops, curation.regroup(crops)).drop("split", "moved").withColumnRenamed("new_split", "split")
    assert first.groupBy("page").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    again = curation.moved(first, curation.regroup(first))
    assert again.filter("moved").count() == 0
    counts = {r["split"]: r["n"] for r in curation.split_counts(again).collect()}
    assert all(abs(counts[s] - w * len(rows)) <= 4 for s, w in SPLIT_WEIGHTS.items())


def test_quotas_equal_the_loop(spark):
    rng = random.Random(1)
    for _ in range(8):
        strata = {f"s{i}": rng.randint(1, 30) for i in range(rng.randint(1, 7))}
        total, sizes = sum(strata.values()), [1, 7, 20, 60, 1000]
        got = {(r["size"], r["stratum"]): r["take"] for r in curation.quotas(spark.createDataFrame(list(strata.items()), "stratum string, n long"), spark.createDataFrame([(s,) for s in sizes], "size long")).collect()}
        for size in sizes:
            want_total = min(size, total)
            take = {s: min(n, round(want_total * n / total)) for s, n in strata.items()}
            chosen = [(s, k) for s in strata for k in range(take[s])][:want_total]
            chosen += [(s, k) for s in strata for k in range(take[s], strata[s])][: want_total - len(chosen)]
            assert {s: sum(c[0] == s for c in chosen) for s in strata} == {s: got[size, s] for s in strata}


def test_splits(spark):
    rows = spark.range(100).withColumn("split", F.lit("train"))
    counts = {r["split"]: r["count"] for r in curation.complete_splits(rows, "id").groupBy("split").count().collect()}
    assert counts == {"train": 80, "validation": 10, "test": 10}
    assert curation.exact_split(spark.range(100), 0.2, "id").filter("is_test").count() == 20
    with pytest.raises(ValueError, match="train"):
        curation.complete_splits(spark.range(3).withColumn("split", F.lit("test")), "id")


def test_cost(spark):
    usage = spark.createDataFrame([("gemini-2.0-flash", 1_000_000, 1_000_000, None, 1.0), ("nobody", 5, 5, 5, 1.0), ("Qwen3.6-35B-A3B", 1, 1, 1, 3600.0)], "model string, input_tokens long, output_tokens long, thinking_tokens long, seconds double")
    costs = {r["model"]: r["cost"] for r in cost.usage_cost(usage, cost.pricing(spark)).collect()}
    assert costs["gemini-2.0-flash"] == pytest.approx(0.5) and costs["nobody"] == 0 and costs["Qwen3.6-35B-A3B"] == pytest.approx(2.8 * 1.08)
    assert len(PRICING) == 19
    chains = {}
    for r in cost.fallback_chains(cost.fallback(spark)).orderBy("step").collect():
        chains.setdefault(r["model"], []).append(r["candidate"])
    assert all(chains[m] == inference.chain(m) for m in chains) and chains["gpt-5.4"] == ["gpt-5.4"]


def test_samples(spark):
    ids = F.array(*[F.lit(x) for x in (1, 2, 3)])
    assert one(spark, samples.padded_labels(ids, 5)) == [1, 2, 3, -100, -100]
    assert one(spark, samples.shifted_right(samples.padded_labels(ids, 5), 9)) == [9, 1, 2, 3, 0]
    assert one(spark, samples.masked_prompt(F.array(*[F.lit(x) for x in (5, 6, 0, 7)]), F.lit(1), [0])) == [-100, 6, -100, 7]
    df = spark.createDataFrame([(1, [1]), (1, [1, 2, 3])], "b int, ids array<int>")
    assert sorted(r["ids"] for r in samples.batch_padded(df, "b", "ids").collect()) == [[1, -100, -100], [1, 2, 3]]


def empty_then_text():
    calls = {}

    def call(model, content):
        if content == b"bad":
            raise RuntimeError("no")
        calls[content] = calls.get(content, 0) + 1
        return ("text" if model != "gemini-2.5-pro" else "", 10, 1)

    return call


def test_inference_seams(spark):
    images = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"bad"))], "path string, content binary")
    rows = {r["path"]: r for r in inference.transcribe(images, "gemini-2.5-pro", empty_then_text).collect()}
    assert (rows["a"]["model"], rows["a"]["text"], rows["a"]["input_tokens"]) == ("gemini-2.0-flash", "text", 40)
    assert rows["b"]["error"] == "RuntimeError: no"
    lines = inference.transcribe_lines(images, lambda: lambda xs: ["t" if b"bad" not in xs else 1 / 0 for _ in xs]).collect()
    assert {r["text"] for r in lines} <= {"t", "ERROR"} and any(r["text"] == "ERROR" for r in lines)
    assert inference.detect(images, lambda: lambda c: [(0, 0.9, 1.0, 1.0, 2.0, 2.0)] * len(c)).count() == 4
    got = inference.extract_entities(spark.createDataFrame([(1, "a(b)")], "id long, text string"), "T {{text}}", "struct<`father's age`:string,p:string>", lambda: lambda p: json.dumps({"father's age": "40", "p": p})).first()
    assert got["entities"]["father's age"] == "40" and got["entities"]["p"] == "T ab"
    done = spark.createDataFrame([(1, 5), (2, 0)], "record_id long, length long")
    todo = spark.createDataFrame([(1, "u"), (2, "u"), (3, "404")], "record_id long, url string")
    assert [r["record_id"] for r in inference.fetch(todo, done, lambda: lambda u: (200, b"x") if u == "u" else (404, b"")).collect()] == [2]
    inference.provider("fake")(empty_then_text)
    assert inference.get_provider("fake")("m", b"x")[0] == "text"
    with pytest.raises(ValueError, match="unknown"):
        inference.get_provider("none")
