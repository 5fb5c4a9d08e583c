"""Trees of many small files are written, read and deleted part after part."""

import pytest
from __spark_entry__ import oracle_sql, queries

from palimpsest.plans import trees
from palimpsest.sinks import files as sinks
from palimpsest.sources import files as sources

from tests.oracle import same


@pytest.mark.parametrize("query", ["sk9_sc9_label_trees", "sc10_named_labels"])
def test_no_more_files_than_a_part_has(spark, sf_dir, monkeypatch, tmp_path, query):
    """1500 label files in parts of some 500; each part is gone when the next one is written."""
    bases, seen = [], []
    monkeypatch.setattr(trees, "FILES_AT_ONCE", 500)
    monkeypatch.setattr(trees, "scratch", lambda s, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}-{len(bases)}")
    real = trees.tree

    def watched(rows, name, extension, base=None):
        bases.append(base)
        out = real(rows, name, extension, base)
        seen.append(len(list(tmp_path.rglob("*.txt"))))
        return out

    monkeypatch.setattr(trees, "tree", watched)
    assert same(queries()[query](spark, sf_dir), oracle_sql()[query], sf_dir)
    assert len(seen) > 1 and max(seen) < sum(seen)
    assert not list(tmp_path.rglob("*.txt"))


def test_folders_are_deleted_by_tasks(spark, tmp_path):
    for name in ("t/a/b/1.txt", "t/a/2.txt", "t/c/3.txt", "t/4.txt", "t/a/b/d/5.txt", "u/6.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sinks.delete_folders(spark, str(tmp_path / "t")) and not (tmp_path / "t").exists()
    assert sources.texts(spark, str(tmp_path / "u"), ".txt").count() == 1
