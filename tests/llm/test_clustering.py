import hashlib
import math
import random

import numpy as np

from kpiloom.llm import clustering, queries


def slow_clusters(rows, k=16, rounds=3, scale=64, dims=64):
    """{position: (cluster, distance)}, inertias and centroids by comparing all distances on Python integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        of = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (x, _) in zip(kept, of) if x == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own)]
    of, inertia = assign(), {}
    for c, d in of:
        inertia[c] = inertia.get(c, 0) + d
    return sorted(
        (-1 if i is None else i, c, d, inertia[c], sum(inertia.values()),
         hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), (c, d) in zip(kept, of))


def got(frame):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"],
                   r["inertia"], r["centroid_sha256"]) for r in frame.collect())


SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "x", "c") for i, v in rows], SCHEMA).repartition(parts)


def test_against_all_distances(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(64)]) for i in range(200)]
    rows += [(i, [float(rng.randint(-1, 1)) / 64 for _ in range(64)]) for i in range(200, 300)]  # many ties
    rows += [rows[7], rows[7], (None, rows[9][1]), (None, None), (301, None), (302, [1.0] * 63), (303, []), (304, [1.0] * 63 + [None]),
             (305, [float("nan")] * 64), (306, [float("inf")] + [0.0] * 63)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = slow_clusters(rows)
    assert got(clustering.cluster(frame(spark, rows))) == want
    assert got(clustering.cluster(frame(spark, rows, 1))) == want


def test_few_vectors_large_numbers_and_none(spark):
    rows = [(i, [float(np.float32(1e7 * (i + 1)))] * 64) for i in range(4)]
    assert got(clustering.cluster(frame(spark, rows))) == slow_clusters(rows)
    same = [(i, [0.5] * 64) for i in range(40)]
    assert got(clustering.cluster(frame(spark, same))) == slow_clusters(same)  # all but the first centroid are empty
    for none in ([], [(1, None)]):
        out = clustering.cluster(frame(spark, none))
        assert out.count() == 0 and out.columns == clustering.cluster(frame(spark, same)).columns


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(queries.op13_clustering(spark, sf)) == slow_clusters(rows)
