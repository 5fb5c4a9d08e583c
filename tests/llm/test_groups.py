from palimpsest.llm.ngram_join import jaccard_groups
from palimpsest.llm.stages import one_of_each_group
from tests.llm.helpers import DOC_SCHEMA


def test_only_components_are_given(spark):
    """A count of links would be one of a spanning part: of a large group no more are verified."""
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} tail{i}", "en", "s", 1) for i in range(3)], DOC_SCHEMA)
    groups = jaccard_groups(docs)
    assert not [c for c in groups.columns if "link" in c]
    assert {r["component_id"] for r in groups.collect()} == {0}


def test_one_stays_of_a_group_without_ids(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("word", "other")]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[0] + " tail"), (None, texts[1]), (7, texts[1] + " tail"), (5, texts[1]), (None, ""), (None, "  ")]
    left = one_of_each_group(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC_SCHEMA)).collect()
    assert [r["doc_id"] for r in left if r["text"].startswith("word")] == [None]
    assert [r["doc_id"] for r in left if r["text"].startswith("other")] == [5]
    assert sorted(r["text"] for r in left if not r["text"].strip()) == ["", "  "]
