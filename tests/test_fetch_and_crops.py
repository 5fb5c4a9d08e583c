import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from palimpsest.operators.images import png
from palimpsest.sinks import crops
from palimpsest.sources import http


@pytest.fixture
def server():
    """Fails twice for each address before it answers; knows no ``none`` and answers ``empty`` with nothing."""
    seen, open_now, most, lock = Counter(), [0], [0], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                seen[self.path] += 1
                open_now[0] += 1
                most[0] = max(most[0], open_now[0])
                n = seen[self.path]
            status = 404 if "none" in self.path else 200 if "empty" in self.path or n > 2 else 503
            body = f"body of {self.path}".encode() if status == 200 and "empty" not in self.path else b""
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
            with lock:
                open_now[0] -= 1

        def log_message(self, *args):
            pass

    one = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=one.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{one.server_port}", seen, most
    one.shutdown()


def test_each_address_is_asked_for_as_often_as_stated(spark, server, tmp_path):
    base, seen, most = server
    path = str(tmp_path / "fetched")
    rows = spark.createDataFrame([(i, f"{base}/i{i}") for i in range(30)] + [(100, f"{base}/none"), (101, f"{base}/empty"), (102, None), (103, "no address at all")], "record_id long, url string")
    first = http.fetch_new(spark, rows, path, tries=3, pause=0.01, side_by_side=3, per_host=2).collect()
    assert len(first) == 34 and all((r["status"], r["asked"], r["error"]) == (200, 3, None) for r in first if r["record_id"] < 100)
    assert {r["record_id"]: (r["status"], r["asked"]) for r in first if r["record_id"] >= 100} == {100: (404, 1), 101: (200, 3), 102: (None, 0), 103: (None, 3)}
    assert all(seen[f"/i{i}"] == 3 for i in range(30)) and seen["/none"] == 1 and seen["/empty"] == 3
    assert most[0] <= 6
    again = http.fetch_new(spark, rows, path, tries=2, pause=0.01).collect()  # only what has no body yet
    assert sorted(r["record_id"] for r in again) == [100, 101, 102, 103] and seen["/i0"] == 3 and seen["/none"] == 2
    bodies = {r["record_id"]: bytes(r["content"]).decode() for r in spark.read.parquet(path).filter("content is not null").collect()}
    assert bodies == {i: f"body of /i{i}" for i in range(30)}


def filtered(pixels, kinds):
    """A PNG file whose lines use the filters ``kinds`` in turn."""
    import struct
    import zlib

    rows, columns, n = pixels.shape
    rgb = pixels[:, :, [2, 1, 0, 3][:n]] if n > 1 else pixels
    lines, zero = [], np.zeros((columns, n), int)
    for y in range(rows):
        kind, line = kinds[y % len(kinds)], rgb[y].astype(int)
        above = rgb[y - 1].astype(int) if y else zero
        left = np.concatenate([zero[:1], line[:-1]])
        corner = np.concatenate([zero[:1], above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", columns, rows, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    body = zlib.compress(b"".join(lines))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body[:40]) + chunk(b"IDAT", body[40:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_files_are_decoded(channels):
    pixels = np.random.default_rng(channels).integers(0, 256, (11, 7, channels), dtype=np.uint8)
    assert (crops.png_pixels(png(pixels)) == pixels).all()
    assert (crops.png_pixels(filtered(pixels, [0, 1, 2, 3, 4])) == pixels).all()
    with pytest.raises(ValueError, match="not a PNG"):
        crops.png_pixels(b"GIF89a")


def test_crops_are_the_pixels_of_their_boxes(spark, tmp_path):
    rng = np.random.default_rng(2)
    images = {f"p{i}": rng.integers(0, 256, (60, 40, 3), dtype=np.uint8) for i in range(5)}
    for name, pixels in images.items():
        (tmp_path / "in" / "sub").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "sub" / f"{name}.png").write_bytes(png(pixels))
    boxes = [(n, 0, "line", 0, 0, 20, 20) for n in images] + [(n, 1, "line", 1, 0, 20, 20) for n in images]  # dropped
    boxes += [(n, 2, "title", 30, 50, 100, 100) for n in images] + [(n, 3, "line", -5, 30, 10, 10) for n in images] + [(n, 4, "line", 500, 0, 5, 5) for n in images] + [("gone", 0, "line", 0, 0, 5, 5)]
    df = spark.createDataFrame(boxes, "image string, seq long, label string, x long, y long, w long, h long")
    got = crops.write_crops(str(tmp_path / "in"), df, str(tmp_path / "out"))
    files = {str(p.relative_to(tmp_path / "out")): crops.png_pixels(p.read_bytes()) for p in (tmp_path / "out").rglob("*.png")}
    assert got.count() == len(files) == 15
    for n, pixels in images.items():
        assert (files[f"{n}/line/000.png"] == pixels[:20, :20]).all() and (files[f"{n}/title/002.png"] == pixels[50:, 30:]).all()
        assert (files[f"{n}/line/003.png"] == pixels[30:40, :5]).all() and f"{n}/line/001.png" not in files
