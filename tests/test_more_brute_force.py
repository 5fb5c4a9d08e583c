"""Queries without SQL, against plain Python over the table."""

import json
import statistics
from collections import defaultdict

import pytest

from palimpsest.plans import views
from palimpsest.plans.registry import QUERIES
from tests.test_grid import fold


def test_nested_report(spark, sf_dir):
    items = QUERIES["a1_a4_item_metrics"](spark, sf_dir).collect()
    got = json.loads(QUERIES["d3_nested_report"](spark, sf_dir).first()[0])
    by_folder = defaultdict(list)
    for r in items:
        by_folder[r["subfolder"]].append(r)
    assert set(got["by_subfolder"]) == set(by_folder)
    for name, own in [*by_folder.items(), (None, items)]:
        found = got["global"] if name is None else got["by_subfolder"][name]
        cers = [r["cer"] for r in own]
        assert found["n"] == len(own)
        assert found["cer_mean"] == pytest.approx(statistics.mean(cers), abs=1e-5) and found["cer_median"] == pytest.approx(statistics.median(cers), abs=1e-5)
        assert found["cer_std"] == pytest.approx(statistics.stdev(cers) if len(own) > 1 else 0, abs=1e-5)
        assert found["exact_pct"] == pytest.approx(100 * statistics.mean(r["exact_match"] for r in own))


def test_chat_messages(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["p30_chat"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        user, answer = json.loads(r["messages"])
        assert user["role"] == "user" and "Transcribe." in json.dumps(user["content"])
        assert answer["role"] == "assistant" and texts[r["doc_id"]] in (answer["content"], *[c.get("text") for c in answer["content"] if isinstance(c, dict)])


def test_crop_metadata(spark, sf_dir):
    """Kept crops by class; the number of a crop counts dropped boxes too."""
    by_image = defaultdict(list)
    for r in views.found_boxes(spark, sf_dir).collect():
        by_image[r["image"]].append(r)
    got = {r["image"]: {"metadata": json.loads(r["metadata"])} for r in QUERIES["sk7_crop_metadata"](spark, sf_dir).collect()}
    import numpy as np

    assert set(got) == set(by_image)
    for image, own in by_image.items():
        own.sort(key=lambda r: r["bid"])
        kept = fold(np.array([[r["x"], r["y"], r["w"], r["h"]] for r in own], float), 0.5)
        names = sorted(c["cropped_image_name"] for crops in got[image]["metadata"].values() for c in crops)
        assert names == [f"{i:03}.jpg" for i in kept]
        for crops in got[image]["metadata"].values():
            for c in crops:
                r = own[int(c["cropped_image_name"][:3])]
                assert [c["coordinates"][k] for k in ("x", "y", "width", "height")] == [r["x"], r["y"], r["w"], r["h"]]
