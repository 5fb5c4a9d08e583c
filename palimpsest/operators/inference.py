"""Where models plug in: each takes a callable that executors run, and gives rows with fixed schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.constants import FALLBACK
from palimpsest.functions.text import render_prompt
from palimpsest.session import importable

Client = Callable[[str, bytes], tuple[str, int, int]]
TRIES = 3
PROVIDERS: dict[str, Callable[[], Client]] = {}


def provider(name: str) -> Callable:
    """Registers a factory of clients; a client takes a model and an image and gives text and tokens in and out."""

    def add(factory: Callable[[], Client]) -> Callable[[], Client]:
        PROVIDERS[name] = factory
        return factory

    return add


def get_provider(name: str) -> Client:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name]()


def chain(model: str, fallback: dict[str, str] = FALLBACK) -> list[str]:
    """A model and those tried after it; one that was tried ends the chain."""
    out = [model]
    while (following := fallback.get(out[-1])) and following not in out:
        out.append(following)
    return out


def transcribe(images: DataFrame, model: str, client: Callable[[], Client], tries: int = TRIES) -> DataFrame:
    """``path, model, text, input_tokens, output_tokens, error`` for each of ``images(path, content)``.

    An empty answer is asked for again, then the next model of the chain; tokens add up under the model that answered.
    An exception is that image's error and stops no other. Calls can repeat if a task does, so results are keyed by path.
    """
    importable(images.sparkSession)
    models = chain(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                text, spent, error, used = "", [0, 0], None, model
                try:
                    for used in models:
                        for _ in range(tries):
                            text, a, b = call(used, content)
                            spent = [spent[0] + a, spent[1] + b]
                            if text:
                                break
                        if text:
                            break
                except Exception as e:  # noqa: BLE001  the row says what went wrong
                    error = f"{type(e).__name__}: {e}"
                out.append((path, used, text, *spent, error))
            yield pd.DataFrame(out, columns=["path", "model", "text", "input_tokens", "output_tokens", "error"])

    return images.select("path", "content").mapInPandas(run, "path string, model string, text string, input_tokens long, output_tokens long, error string")


def transcribe_lines(images: DataFrame, recognise: Callable[[], Callable[[list[bytes]], list[str]]], batch: int = 32) -> DataFrame:
    """``path, text`` of line images; if a batch fails all its rows have the text ERROR."""
    importable(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = recognise()
        for df in batches:
            texts: list[str] = []
            for at in range(0, len(df), batch):
                part = list(df["content"][at : at + batch])
                try:
                    texts += model(part)
                except Exception:  # noqa: BLE001
                    texts += ["ERROR"] * len(part)
            yield pd.DataFrame({"path": df["path"], "text": texts})

    return images.select("path", "content").mapInPandas(run, "path string, text string")


def detect(images: DataFrame, detector: Callable[[], Callable[[bytes], list[tuple[int, float, float, float, float, float]]]]) -> DataFrame:
    """``image, seq, class_id, confidence, cx, cy, w, h`` of each image's regions in the model's order."""
    importable(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = detector()
        for df in batches:
            rows = [(path, k, *region) for path, content in zip(df["path"], df["content"], strict=True) for k, region in enumerate(model(content))]
            yield pd.DataFrame(rows, columns=["image", "seq", "class_id", "confidence", "cx", "cy", "w", "h"])

    return images.select("path", "content").mapInPandas(run, "image string, seq int, class_id int, confidence double, cx double, cy double, w double, h double")


def transform_images(images: DataFrame, transform: Callable[[bytes], bytes]) -> DataFrame:
    """``path, content`` with each image's bytes changed (grey, denoised, lower contrast, decoded ...)."""
    importable(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"path": df["path"], "content": [transform(c) for c in df["content"]]})

    return images.select("path", "content").mapInPandas(run, "path string, content binary")


def fetch(rows: DataFrame, done: DataFrame, get: Callable[[], Callable[[str], tuple[int, bytes]]], tries: int = 3) -> DataFrame:
    """``record_id, content`` of rows whose image isn't there yet; only status 200 with a body counts."""
    importable(rows.sparkSession)
    todo = rows.join(done.filter("length > 0").select("record_id"), "record_id", "left_anti").select("record_id", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = get()
        for df in batches:
            out = []
            for record_id, url in zip(df["record_id"], df["url"], strict=True):
                for _ in range(tries):
                    try:
                        status, body = call(url)
                    except OSError:
                        continue
                    if status == 200 and body:
                        out.append((record_id, body))
                        break
            yield pd.DataFrame(out, columns=["record_id", "content"])

    return todo.mapInPandas(run, "record_id long, content binary")


def extract_entities(texts: DataFrame, template: str, schema: str, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``id, entities``: the client's JSON answers to the rendered prompts, read by ``schema``."""
    importable(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for df in batches:
            yield pd.DataFrame({"id": df["id"], "answer": [call(p) for p in df["prompt"]]})

    prompts = texts.select("id", render_prompt(template, F.col("text")).alias("prompt"))
    return prompts.mapInPandas(run, "id long, answer string").select("id", F.from_json("answer", schema).alias("entities"))
