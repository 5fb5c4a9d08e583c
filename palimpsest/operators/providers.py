"""Chat endpoints over HTTP, asked side by side within bounds, and again with sampling where they say nothing."""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import strip, without_thinking
from palimpsest.session import importable, stash

#: ``model, image, temperature`` to text, tokens in and tokens out
Ask = Callable[[str, bytes, float], tuple[str, int, int]]
#: first bytes of files by their type
MAGIC = {b"\x89PNG": "image/png", b"RIFF": "image/webp"}
#: at least this warm when asked again: a greedy answer that stops at once would do so each time
WARM = 0.5


def asked(images: DataFrame, model: str, ask: Callable[[], Ask], temperature: float, at_once: int) -> DataFrame:
    """``path, text, input_tokens, output_tokens, error``: one call for each image, ``at_once`` of them open in a task. A call
    that fails gives its error."""
    importable(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = ask()

        def one(content: bytes) -> tuple[str | None, int, int, str | None]:
            try:
                return *call(model, content, temperature), None
            except Exception as e:  # the row says what went wrong, the others go on
                return None, 0, 0, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                said = list(pool.map(one, batch.column("content").to_pylist()))
                columns = [pa.array(c, t) for c, t in zip(zip(*said, strict=True) if said else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.record_batch([batch.column("path"), *columns], names=["path", "text", "input_tokens", "output_tokens", "error"])

    out = images.select("path", "content").mapInArrow(run, "path string, text string, input_tokens long, output_tokens long, error string")
    return out.withColumn("text", without_thinking(F.coalesce("text", F.lit(""))))


def answered(images: DataFrame, model: str, ask: Callable[[], Ask], temperature: float = 0.0, at_once: int = 8) -> DataFrame:
    """``path, text, input_tokens, output_tokens, error`` of ``images(path, content)`` with different paths.

    All images are asked about once and the answers written. Those with a blank answer are asked about again in a second pass,
    with sampling; the tokens of both calls count, and where the second answer is blank too the first stays.
    """
    first = stash(asked(images, model, ask, temperature, at_once), "answers")
    blank = first.filter(F.col("error").isNull() & (strip(F.col("text")) == "")).select("path")
    again = stash(asked(images.join(blank, "path", "left_semi"), model, ask, max(temperature, WARM), at_once), "answers")
    names = {c: f"second_{c}" for c in ("text", "input_tokens", "output_tokens")}
    both = first.join(again.select("path", *[F.col(c).alias(n) for c, n in names.items()]), "path", "left")
    text = F.when(strip(F.col("second_text")) != "", F.col("second_text")).otherwise(F.col("text"))
    tokens = [(F.col(c) + F.coalesce(f"second_{c}", F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")]
    return both.select("path", text.alias("text"), *tokens, "error")


def chat_ask(url: str, prompt: str, key: str = "", max_tokens: int = 4096, thinking: bool = True, timeout: float = 120) -> Ask:
    """Asks an endpoint for chat completions (``<url>/chat/completions``) with a prompt and an image as a data URL."""

    def ask(model: str, image: bytes, temperature: float) -> tuple[str, int, int]:
        mime = MAGIC.get(image[:4], "image/jpeg")
        parts = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:{mime};base64,{base64.b64encode(image).decode()}"}}]
        body = {"model": model, "messages": [{"role": "user", "content": parts}], "temperature": temperature, "max_tokens": max_tokens}
        if not thinking:
            body["chat_template_kwargs"] = {"enable_thinking": False}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with urllib.request.urlopen(urllib.request.Request(f"{url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers), timeout=timeout) as answer:
            got = json.load(answer)
        used = got.get("usage") or {}
        return got["choices"][0]["message"]["content"] or "", used.get("prompt_tokens", 0), used.get("completion_tokens", 0)

    return ask
