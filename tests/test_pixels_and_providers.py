"""Pixels against plain loops; a chat endpoint of our own; text reports and logs."""

import json
import logging
import threading
from functools import partial
from http.server import BaseHTTPRequestHandler, HTTPServer
from math import exp

import numpy as np

from palimpsest.log import logger
from palimpsest.operators import images, providers
from palimpsest.sinks import files as sinks
from palimpsest.sources import files as sources


def pixels(rows, columns, channels, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (rows, columns, channels), dtype=np.uint8)


def table(spark, *arrays):
    rows = [(str(i), *a.shape, images.MODES[a.shape[2]], a.tobytes()) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, images.SCHEMA)


def mirrored(i, n):
    """Index that a place beyond an edge stands for; the edge itself isn't repeated."""
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


def plain_denoise(a, h, template, search):
    rows, columns, channels = a.shape
    r, reach = template // 2, search // 2
    at = lambda y, x, c: float(a[mirrored(y, rows), mirrored(x, columns), c])
    out = np.zeros(a.shape, np.uint8)
    for y in range(rows):
        for x in range(columns):
            total, mean = 0.0, [0.0] * channels
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    apart = sum((at(y + v, x + u, c) - at(y + dy + v, x + dx + u, c)) ** 2 for v in range(-r, r + 1) for u in range(-r, r + 1) for c in range(channels))
                    w = exp(-apart / (template * template * channels * h * h))
                    total += w
                    mean = [m + w * at(y + dy, x + dx, c) for c, m in enumerate(mean)]
            out[y, x] = [round(m / total) for m in mean]
    return out


def test_denoise_equals_plain_loops():
    for a in (pixels(7, 9, 1) // 16, pixels(6, 8, 3) // 8):
        got, want = images.denoise(a, 5, 3, 5), plain_denoise(a, 5, 3, 5)
        assert np.abs(got.astype(int) - want).max() <= 1 and (got == want).mean() > 0.97  # halves may round apart
    flat = np.full((12, 12, 1), 77, np.uint8)
    assert (images.denoise(flat) == 77).all()


def test_grey_and_contrast():
    a = pixels(5, 6, 3)
    for y in range(5):
        for x in range(6):
            b, g, r = map(int, a[y, x])
            assert images.grey(a)[y, x, 0] == round(0.299 * r + 0.587 * g + 0.114 * b)
            assert list(images.contrast(a, 1.1, -0.3)[y, x]) == [int(min(255, max(0, v * 1.1 - 76.5))) for v in (b, g, r)]
    assert images.grey(a[:, :, :1]) is not None and (images.grey(a[:, :, :1]) == a[:, :, :1]).all()


def test_files_are_decoded_as_they_were(spark, tmp_path):
    every = [pixels(3, 5, 1), pixels(4, 2, 3), pixels(2, 3, 4), pixels(1, 1, 3)]
    for i, a in enumerate(every):
        (tmp_path / f"{i}.png").write_bytes(images.png(a))
    (tmp_path / "x.png").write_bytes(b"none")
    back = {r["origin"].split("/")[-1]: r for r in sources.decoded(spark, str(tmp_path)).collect()}
    assert sorted(back) == [f"{i}.png" for i in range(4)]
    for i, a in enumerate(every):
        assert (images.pixels_of(type("Row", (), back[f"{i}.png"].asDict())) == a).all()
    assert images.encoded(table(spark, *every)).count() == 4


def test_lower_contrast_is_darker_and_reruns_agree(spark):
    df = table(spark, *[pixels(8, 8, 3, s) for s in range(6)])
    one, two = [sorted((r["origin"], bytes(r["data"])) for r in images.lower_contrast(df).collect()) for _ in range(2)]
    assert one == two
    before = {r["origin"]: np.frombuffer(r["data"], np.uint8).mean() for r in df.collect()}
    assert all(np.frombuffer(data, np.uint8).mean() < before[origin] for origin, data in one)
    assert images.lower_contrast(df.limit(0)).count() == 0 and images.changed(df.limit(0), images.grey).count() == 0


def slow_ask(folder):
    """Answers by the image's bytes, and leaves a file for each call while it is open."""
    import os
    import time
    import uuid

    def ask(model, image, temperature):
        name = uuid.uuid4().hex
        open(f"{folder}/open-{name}", "w").close()
        open_now = len([f for f in os.listdir(folder) if f.startswith("open-")])
        open(f"{folder}/call-{open_now}-{temperature}-{image.decode()}-{name}", "w").close()
        time.sleep(0.05)
        os.remove(f"{folder}/open-{name}")
        if image == b"d":
            raise OSError("no route")
        return {b"a": "text", b"b": "" if temperature < 0.5 else "<think>x</think>\n warm", b"c": " "}[image], 3, 2

    return ask


def test_blank_answers_are_sampled_again(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k}{i}", k.encode()) for k in "abcd" for i in range(6)], "path string, content binary").coalesce(1)
    out = {r["path"]: (r["text"], r["input_tokens"], r["output_tokens"], r["error"]) for r in providers.answered(rows, "m", partial(slow_ask, str(tmp_path)), at_once=3).collect()}
    want = {"a": ("text", 3, 2, None), "b": ("warm", 6, 4, None), "c": (" ", 6, 4, None), "d": ("", 0, 0, "OSError: no route")}
    assert out == {f"{k}{i}": want[k] for k in "abcd" for i in range(6)}
    calls = [p.name.split("-") for p in tmp_path.glob("call-*")]
    assert len(calls) == 24 + 12 and {c[2] for c in calls if c[3] in "ad"} == {"0.0"} and max(int(c[1]) for c in calls) in (2, 3)
    assert providers.answered(rows.limit(0), "m", partial(slow_ask, str(tmp_path))).count() == 0


class Endpoint(BaseHTTPRequestHandler):
    got: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Endpoint.got.append((self.path, self.headers.get("Authorization"), body))
        answer = {"choices": [{"message": {"content": "<think>hm</think> said" if body["temperature"] else ""}}], "usage": {"prompt_tokens": 7, "completion_tokens": 1}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *args):
        pass


def chat_client(url):
    return providers.chat_ask(url, "Read.", key="k", thinking=False)


def test_chat_endpoint(spark):
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        images_ = spark.createDataFrame([("a", b"\x89PNG1"), ("b", b"other")], "path string, content binary").coalesce(1)
        out = providers.answered(images_, "some-model", partial(chat_client, f"http://127.0.0.1:{server.server_port}/v1/"), at_once=1).orderBy("path").collect()
    finally:
        server.shutdown()
    assert [(r["text"], r["input_tokens"], r["output_tokens"], r["error"]) for r in out] == [("said", 14, 2, None)] * 2
    path, key, body = Endpoint.got[0]
    assert path == "/v1/chat/completions" and key == "Bearer k" and body["model"] == "some-model" and body["chat_template_kwargs"] == {"enable_thinking": False}
    assert body["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/png;base64,")


def test_metadata_is_joined_within_its_folder(spark, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.jpg").write_bytes(b"x")
        (tmp_path / folder / "metadata.jsonl").write_text(json.dumps({"file_name": "a.jpg", "k": folder}))
    rows = sources.image_folder(spark, str(tmp_path)).collect()
    assert sorted((r["path"].split("/")[-2], r["k"]) for r in rows) == [("one", "one"), ("two", "two")]


def test_sections(spark):
    df = spark.createDataFrame([(" ", "b", 3, 0.5), ("c", None, 12, 0.25)], "ref string, hyp string, n int, share double").orderBy("n")
    text = sinks.sections_text({"Confusions": df, "None": df.limit(0)}, most=2)
    assert text.split("\n")[:4] == ["=== Confusions ===", "ref  hyp  n   share", "' '  b    3   0.5000", "c         12  0.2500"] and "=== None ===\nref  hyp  n  share" in text
    assert len(sinks.sections_text({"One": df}, most=1).strip().split("\n")) == 3


def test_log_has_one_handler_for_each_place(tmp_path):
    for _ in range(3):
        log = logger("palimpsest.test", logging.INFO, str(tmp_path / "logs/run.txt"))
    assert len(log.handlers) == 2
    log.info("said once")
    assert (tmp_path / "logs/run.txt").read_text().count("said once") == 1
