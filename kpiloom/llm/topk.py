"""Exact top-k inner-product search by MaxScore over shards of dimension postings.

A query's terms are the dimensions. In a shard, a dimension's posting holds all its vectors' components, with
the least and the greatest as bounds. The dimensions that could not lift a vector over the current k-th score
between them are non-essential: the essential postings are traversed for all vectors, the others are probed
only for vectors that are still competitive.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import materialised

_PROBE = 8  # non-essential dimensions probed between two cuts of the candidates


def usable_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); rows with a null vector or a null, NaN or infinite
    component are left out."""
    exact = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(exact, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull()).where(finite).select(
        "vec_id", F.transform(exact, lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((dims, len(column)))
    for i, v in enumerate(column):
        out[: len(v), i] = v
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def maxscore(postings: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple:
    """(ids, scores) of the shard's best k for one query; ``postings`` is dimension by vector."""
    low, high = postings.min(axis=1), postings.max(axis=1)
    upper, lower = np.maximum(query * low, query * high), np.minimum(query * low, query * high)
    order = np.argsort(lower - upper, kind="stable")
    head = min(len(ids), 8 * k)  # fully scored to get a first threshold
    scores = query @ postings[:, :head]
    keep = ids[:head] != own
    got_ids, got = ids[:head][keep], scores[keep]
    at = _best(got, got_ids, k)
    got_ids, got = got_ids[at], got[at]
    if head == len(ids):
        return got_ids, got
    threshold = got[-1] if len(got) == k else -math.inf
    rest_upper = np.append(np.cumsum(upper[order][::-1])[::-1], 0.0)  # of dimensions from here on
    first_lower = np.append(0.0, np.cumsum(lower[order]))
    essential = int(np.argmax(first_lower + rest_upper < threshold)) if threshold > -math.inf else 0
    if not (first_lower + rest_upper < threshold).any():
        essential = len(order)
    dims = order[:essential]
    partial = query[dims] @ postings[dims, head:]
    alive = np.arange(head, len(ids))
    for start in range(essential, len(order), _PROBE):
        competitive = partial + rest_upper[start] >= threshold
        alive, partial = alive[competitive], partial[competitive]
        dims = order[start : start + _PROBE]
        partial = partial + query[dims] @ postings[np.ix_(dims, alive)]
    keep = ids[alive] != own
    all_ids, all_scores = np.append(got_ids, ids[alive][keep]), np.append(got, partial[keep])
    at = _best(all_scores, all_ids, k)
    return all_ids[at], all_scores[at]


def search(
    vectors: DataFrame, query_step: int = 50, k: int = 5, scale: int = 256,
    shard_rows: int = 8192, block_rows: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors by integer inner product.

    Queries are the vectors whose id is divisible by ``query_step``. Vectors are dealt to shards and queries
    to blocks by hash, so that both fit a task; every (block, shard) cell is searched once and the cells'
    results are merged per query. Scores are exact: where one may not fit 53 bits, the cell is computed on
    Python integers; a score beyond a long is an error. Ties go to the smaller vec_id; repeated rows of a vector are all candidates. A null id
    is neither query nor candidate. Shorter vectors count as padded with zeros. Empty tables give no rows.
    """
    usable = materialised(usable_vectors(vectors.where("vec_id is not null"), scale), "topk-vectors")
    queries = usable.where(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id"])
    shards = max(1, math.ceil(usable.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))

    left = usable.select(
        "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select(
        F.col("vec_id").alias("query_id"), "v",
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def cell(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(vs) and len(qs):
            dims = max(map(len, [*vs["v"], *qs["v"]]))
            ids, postings, asked = vs["vec_id"].to_numpy(), _matrix(vs["v"], dims), _matrix(qs["v"], dims)
            if dims and np.abs(postings).max() * np.abs(asked).max() * dims >= 2.0**53:
                postings, asked = (m.astype(object) for m in (
                    np.array([[int(x) for x in r] for r in postings], dtype=object),
                    np.array([[int(x) for x in r] for r in asked], dtype=object)))
            for j, q in enumerate(qs["query_id"].to_numpy()):
                if postings.dtype == object:
                    scores = asked[:, j] @ postings
                    ranked = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)[:k]
                    best, scores = [i for _, i in ranked], [-s for s, _ in ranked]
                else:
                    best, scores = maxscore(postings, ids, asked[:, j], q, k) if dims else (
                        np.sort(ids[ids != q])[:k], np.zeros(min(k, int((ids != q).sum()))))
                out["query_id"] += [q] * len(best)
                out["vec_id"] += list(best)
                out["score"] += [int(s) for s in scores]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    cells = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(
        cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
