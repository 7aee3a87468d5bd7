import random

import pytest

from kpiloom.llm import topk


def slow(rows, step, k, scale=256):
    import math

    usable = {}
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in rows if i % step == 0}:
        query = next(v for i, v in rows if i == q)
        scores = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in rows if i != q)[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)}
    return out | usable.keys()


def got(frame, **options):
    return {tuple(r) for r in topk.search(frame, **options).collect()}


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_against_all_pairs(spark, shard_rows):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(1000, None), (1010, [None] * 24), (1020, [float("nan")] * 24), (1030, [float("inf")] + [0.0] * 23),
             (1040, []), (1050, [1.0, -1.0]), (None, [0.5] * 24), (1060, [0.0] * 24)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    stored = [(r[0], r[1]) for r in frame.collect()]
    assert got(frame, query_step=10, k=5, shard_rows=shard_rows, block_rows=20) == slow(stored, 10, 5)


def test_large_components(spark):
    rows = [(i, [float(3**i), -(2.0 ** (i + 18)), 1.5]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rows = [(i, v) for i, v in rows]
    assert got(frame, query_step=4, k=3, scale=1) == slow(rows, 4, 3, 1)


def test_fewer_than_k_extra_columns_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0], 1, 2), (1, [2.0], 1, 2)], "vec_id long, embedding array<double>, rank int, v int")
    assert got(frame) == {(0, 1, 1, 256 * 512)}
    assert got(frame.where("vec_id < 0")) == set()
    assert got(frame.where("vec_id = 0")) == set()
