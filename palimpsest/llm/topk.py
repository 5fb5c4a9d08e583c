"""Exact top-k search: each query's weighted postings are scattered into dense score arrays, term at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.base import pick
from palimpsest.session import importable, stash

ROWS_A_CELL = 16_384
QUERIES_A_CELL = 4_096
LONG = (-(1 << 63), (1 << 63) - 1)


def integers(vectors: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every component with floor(256 * x) other than 0; beyond a long's range its ends."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = flat.offsets.to_numpy()
    values = np.floor(flat.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64) * 256)
    inside = np.abs(values) < 2.0**63
    weights = np.where(inside, np.where(inside, values, 0).astype(np.int64), np.where(values > 0, LONG[1], LONG[0]))
    lens = np.diff(offsets)
    rows = np.repeat(np.arange(len(lens)), lens)
    terms = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lens)
    keep = weights != 0
    return rows[keep], terms[keep], weights[keep]


def best(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, own rows left out; places are in the order of ids, so ties go to the smaller id."""
    others = np.flatnonzero(~own) if own.any() else None
    values = scores if others is None else scores[others]
    if len(values) > k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        above = np.flatnonzero(values > least)
        chosen = np.concatenate([above, np.flatnonzero(values == least)[: k - len(above)]])
    else:
        chosen = np.arange(len(values))
    return chosen if others is None else others[chosen]


def search_cell(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best rows of one cell for each of its queries."""
    rows = rows.sort_by("vec_id")
    ids = rows["vec_id"].to_numpy()
    at, terms, weights = integers(rows["embedding"])
    order = np.argsort(terms, kind="stable")
    at, terms, weights = at[order], terms[order], weights[order]
    names, starts = np.unique(terms, return_index=True)
    postings = {int(t): (at[a:b], weights[a:b]) for t, a, b in zip(names, starts, [*starts[1:], len(terms)], strict=True)}
    q_ids, q_keys = queries["query_id"].to_numpy(), queries["query_key"].to_numpy()
    q_at, q_terms, q_weights = integers(queries["embedding"])
    bounds = np.searchsorted(q_at, np.arange(len(q_ids) + 1))
    out: list[list[np.ndarray]] = [[], [], [], []]
    for q in range(len(q_ids)):
        scores = np.zeros(len(ids), np.int64)
        for term, weight in zip(q_terms[bounds[q] : bounds[q + 1]].tolist(), q_weights[bounds[q] : bounds[q + 1]].tolist(), strict=True):
            if term in postings:
                where, values = postings[term]
                if len(where) == len(ids):  # every row has the term: the scatter is an addition
                    scores += values * weight
                else:
                    scores[where] += values * weight
        top = best(scores, ids == q_ids[q], k)
        for column, values in zip(out, (np.full(len(top), q_ids[q]), np.full(len(top), q_keys[q]), ids[top], scores[top]), strict=True):
            column.append(values)
    names = ["query_id", "query_key", "vec_id", "score"]
    return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for n, c in zip(names, out, strict=True)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``vectors(vec_id, embedding)``: k best rows for each row with ``is_query``.

    Rows and queries are dealt out over a grid of cells by the hash of their ids, so that every query meets every row in
    one cell; a cell holds about ``ROWS_A_CELL`` rows and ``QUERIES_A_CELL`` queries at any size of the input. Each cell
    gives k rows for each of its queries, merged by rank. Scores are sums of 64-bit products.

    A vector that is null or has a null or non-finite component takes no part, as query or candidate; an empty one scores
    0. Of vectors of unequal length the missing components are 0. Repeated equal query rows are one query; queries with
    one id and different vectors are ranked each. Rows with a query's id are not its candidates. Null ids take no part.
    An empty table, or one without queries, gives no row. Other columns, also ones with clashing names, are left.
    """
    spark = vectors.sparkSession
    importable(spark)
    sound = pick(vectors, "vec_id", "embedding").filter(
        "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    )
    sound = stash(sound.withColumn("q", F.coalesce(is_query, F.lit(False))).withColumn("h", F.xxhash64("vec_id")), "vectors")
    counts = sound.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    down, across = max(1, -(-counts["n"] // ROWS_A_CELL)), max(1, -(-counts["q"] // QUERIES_A_CELL))
    rows = sound.select("vec_id", "embedding", F.expr(f"pmod(h, {down})").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))
    queries = (
        sound.filter("q")
        .select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query_key"), "embedding", F.expr(f"pmod(shiftright(h, 32), {across})").cast("int").alias("c"))
        .dropDuplicates(["query_id", "query_key"])
        .select("query_id", "query_key", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("r"), "c")
    )

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search_cell(a, b, k)

    parts = rows.groupBy("r", "c").cogroup(queries.groupBy("r", "c")).applyInArrow(run, "query_id long, query_key long, vec_id long, score long")
    ranked = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
