"""Severity of toxic language by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.base import map_arrow, pick, text_of
from palimpsest.session import stash

SPACE = 1 << 22
PREFIXES = (3, 4, 5, 6)
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\~^`=+«»„“”‘’…¡¿"
REMEMBERED = 600_000


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word without its edges: itself, and its first letters if it goes on."""
    word = word.strip(EDGES).lower()
    if len(word) < 2:
        return ()
    return tuple({xxhash.xxh32_intdigest(f) % SPACE for f in (f"{word}$", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n))})


class Features:
    """Features of texts by a memo of words: how often each base feature occurs, in steps, and how densely.

    A feature's number is ``8 * base + level``: levels 0 to 2 say that it occurs at least once, twice, four times, levels 3
    and 4 that it occurs more than once and makes up a 300th or a 120th of the words. With ``known`` only features of the model are looked up.
    """

    def __init__(self, known: dict[int, int] | None = None) -> None:
        self.known, self.memo = known, {}
        self.bases = None if known is None else {f >> 3 for f in known}

    def of(self, text: str) -> list[int]:
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        memo, held, words = self.memo, {}, text.split()
        for word, n in Counter(words).items():
            got = memo.get(word)
            if got is None:
                got = word_features(word)
                if self.bases is not None:
                    got = tuple(f for f in got if f in self.bases)
                memo[word] = got
            for f in got:
                held[f] = held.get(f, 0) + n
        out = []
        for f, n in held.items():
            out += [8 * f + level for level, least in enumerate((1, 2, 4, max(2, len(words) / 300), max(2, len(words) / 120))) if n >= least]
        known = self.known
        return sorted(out) if known is None else sorted(known[f] for f in out if f in known)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class CumulativeLink:
    """P(grade <= k) = sigmoid(threshold[k] - weights . features): one weight vector for all ordered thresholds."""

    index: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])

    def fit(self, rows: np.ndarray, columns: np.ndarray, n: int, grades: np.ndarray, penalty: float = 2e-4, rounds: int = 300, rate: float = 0.15) -> CumulativeLink:
        """Penalised likelihood by Adam; ``rows, columns`` are the places of ones in the n by len(index) matrix."""
        d, levels = len(self.index), int(grades.max(initial=0)) + 1
        if levels < 2:  # one grade only: nothing is above it
            self.weights, self.thresholds = np.zeros(d), np.zeros(0)
            return self
        share = np.array([(grades <= k).mean() for k in range(levels - 1)]).clip(1e-4, 1 - 1e-4)
        # ordered thresholds: the first, then logs of the steps up
        start = np.log(share / (1 - share))
        params = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
        m, v = np.zeros_like(params), np.zeros_like(params)
        low, high = grades - 1, grades
        for step in range(1, rounds + 1):
            weights, first, steps = params[:d], params[d], np.exp(np.clip(params[d + 1 :], -6, 3))
            thresholds = first + np.concatenate([[0.0], np.cumsum(steps)])
            scores = np.bincount(rows, weights[columns], n)
            edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
            upper, lower = sigmoid(edges[high + 1] - scores), sigmoid(edges[low + 1] - scores)
            p = np.maximum(upper - lower, 1e-12)
            up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
            slope = (up - down) / n  # d loss / d score
            grad_t = np.array([-(up[high == k]).sum() + (down[low == k]).sum() for k in range(levels - 1)]) / n
            grad = np.concatenate([np.bincount(columns, slope[rows], d) + penalty * weights, [grad_t.sum()], [grad_t[k + 1 :].sum() * steps[k] for k in range(levels - 2)]])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = params[:d]
        self.thresholds = params[d] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(params[d + 1 :], -6, 3)))])
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, least: int = 6, most: int = 8_192) -> CumulativeLink:
    """Fit on at most ``sample`` labelled documents, those whose ids hash lowest.

    ``labels(doc_id, toxic)`` holds whole grades from 0. Where there are only two, the toxic documents are split at the
    median of their share of terms that go with the label, so that severity has the grades none, mild and severe. Of the
    features in at least ``least`` documents the ``most`` with the largest weight of evidence are used: others say less
    about the label than chance would, and a penalty alone would keep millions of them in the model that every task holds.
    Null ids and labels don't count, of several labels of an id the highest does, of several texts of an id the first in
    order; ties of hashes go by id and of evidence by feature. Without labels, or with one grade, nothing is toxic.
    """
    marks = pick(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("grade"))
    chosen = marks.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).select("doc_id", "grade")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([features.of(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "grade", "features"])

    texts = pick(docs, "doc_id", "text").filter("doc_id is not null")
    # at most `sample` small rows are sent; of repeated ids one text stays, so as many rows come back
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min(text_of()).alias("text"))
    rows = stash(map_arrow(joined, featured, "doc_id long, grade int, features array<long>"), "features")
    base = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("grade") > 0).cast("double")), F.lit(0.0)).alias("share")).first()
    share, held = F.lit(base["share"]), F.col("held")
    evidence = F.abs(F.col("hits") - held * share) / F.sqrt(F.greatest(held * share * (1 - share), F.lit(1e-9)))
    held_by = rows.select(F.explode("features").alias("f"), (F.col("grade") > 0).cast("long").alias("hit")).groupBy("f").agg(F.count("*").alias("held"), F.sum("hit").alias("hits"))
    best = held_by.filter(held >= least).withColumn("evidence", F.round(evidence, 9)).orderBy(F.col("evidence").desc(), "f").limit(most).collect()
    model = CumulativeLink({f: i for i, f in enumerate(sorted(r["f"] for r in best))})
    telling = np.zeros(len(best))
    for r in best:
        telling[model.index[r["f"]]] = r["hits"] / r["held"] > 0.5
    index = model.index

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array([index[f] for f in fs if f in index], "<u4").tobytes() for fs in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["doc_id", "grade", "features"])

    got = sorted((r["doc_id"], r["grade"], bytes(r["features"])) for r in map_arrow(rows, narrowed, "doc_id long, grade int, features binary").collect())
    grades = np.array([max(0, g) for _, g, _ in got], np.int64)
    flat = [np.frombuffer(f, "<u4") for _, _, f in got]
    n = len(flat)
    places = np.repeat(np.arange(n), [len(f) for f in flat]) if n else np.zeros(0, np.int64)
    columns = np.concatenate(flat).astype(np.int64) if n else np.zeros(0, np.int64)
    if n and grades.max() == 1:
        density = np.bincount(places, telling[columns], n) / np.maximum(np.bincount(places, minlength=n), 1)
        grades[(grades == 1) & (density > np.median(density[grades == 1]))] = 2
    return model.fit(places, columns, n, grades)


def predict(docs: DataFrame, model: CumulativeLink, threshold: float = 0.3) -> DataFrame:
    """``doc_id, expected_severity, severity, toxic`` for each row of ``docs(doc_id, text)``; no shuffle.

    ``expected_severity`` sums P(grade > k) over the thresholds, ``severity`` is the likeliest grade, ``toxic`` says whether
    P(grade > 0) is at least ``threshold``. Null and empty texts have no features. Texts are read whole, however long.
    Repeated rows are judged each, an empty table gives an empty one, columns other than the two are left, also ones with
    clashing names.
    """
    known = model.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(known)
        for batch in batches:
            scores = np.array([model.weights[features.of(t)].sum() if t else 0.0 for t in batch.column(1).to_pylist()])
            above = model.above(scores)
            whole = np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1)
            grade = np.argmax(whole[:, :-1] - whole[:, 1:], axis=1) if len(scores) else np.zeros(0, np.int64)
            toxic = above[:, 0] >= threshold if above.shape[1] else np.zeros(len(scores), bool)
            yield pa.record_batch([batch.column(0), pa.array(above.sum(axis=1), pa.float64()), pa.array(grade, pa.int32()), pa.array(toxic, pa.bool_())], names=["doc_id", "expected_severity", "severity", "toxic"])

    return map_arrow(pick(docs, "doc_id", "text"), run, "doc_id long, expected_severity double, severity int, toxic boolean")
