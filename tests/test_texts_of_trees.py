"""Files without bytes hold no text, and labels' texts go to no driver."""

import pytest
from __spark_entry__ import oracle_sql, queries

from palimpsest.sources import files as sources

from tests.oracle import same


@pytest.mark.parametrize("query", ["sc4_sc20_sk4_texts", "sc4_texts_by_tasks"])
def test_documents_without_text_have_none(spark, tmp_path, query):
    rows = [(1, " one\n", "en", "a", 5), (2, "", "en", "a", 0), (3, None, "fr", "a", None), (4, " \n ", None, "a", 3), (5, "zwei é", "de", "a", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert same(queries()[query](spark, str(tmp_path)), oracle_sql()[query], str(tmp_path)) == 3


def test_texts_of_labels_are_not_joined(spark, tmp_path):
    """A join of what files hold is planned by the size of their paths: it was broadcast, whatever the size."""
    for name, text in (("train/images/s/a.jpg", "x"), ("train/images/s/b.jpg", "x"), ("train/images/s/c.png", "x"), ("train/labels/s/a.txt", " one "), ("train/labels/s/c.txt", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found, old = sources.split_crops(spark, str(tmp_path)), sources.legacy_annotations(spark, str(tmp_path))
    for df in (found, old):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["split"], r["subfolder"], r["filename"], r["text"]) for r in found.collect()) == [("train", "s", "a.jpg", "one"), ("train", "s", "b.jpg", ""), ("train", "s", "c.png", "")]
    assert [(r["filename"], r["text"], r["path"]) for r in old.collect()] == [("a.jpg", "one", f"file:{tmp_path}/train/images/s/a.jpg")]
