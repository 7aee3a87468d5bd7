"""Centroid clustering by a bisector tournament on whole numbers.

Between two centroids lies a bisecting plane: an integer normal and a threshold tell on which side a vector is,
and so which of the two is nearer. The normals of all pairs are made once a round; a vector then finds its
centroid by k - 1 sign tests, each of which eliminates one, and only the winner's distance is computed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import materialised

_SAFE = 1 << 26  # with components up to here every sum of 64 products fits 64 bits


def kept_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, x): vectors of ``dims`` components as doubles, none null or non-finite."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where((F.size("embedding") == dims) & finite).select("vec_id", x.alias("x"))


def hash_order(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))).cast("binary"), 256)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers, or as Python's where a sum of products could pass 64 bits."""
    scaled = np.floor(x * float(scale))
    if scaled.size and np.abs(scaled).max() > _SAFE:
        return np.array([[int(v) for v in row] for row in scaled], dtype=object).reshape(scaled.shape)
    return scaled.astype(np.int64)


class Bisectors:
    """Normals 2 (b - a) and thresholds b.b - a.a of all pairs of centroids: b is nearer where x.normal is greater."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        small = all(abs(v) <= _SAFE for c in centroids for v in c)
        self.centroids = np.array(centroids, dtype=np.int64 if small else object)
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        square = (self.centroids * self.centroids).sum(axis=1)
        self.thresholds = square[None, :] - square[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid, the smaller number where two are as near."""
        best = np.zeros(len(x), dtype=np.int64)
        for k in range(1, len(self.centroids)):
            side = (x * self.normals[best, k]).sum(axis=1) - self.thresholds[best, k]
            best = np.where(side > 0, k, best)
        apart = x - self.centroids[best]
        return best, (apart * apart).sum(axis=1)


def _matrix(column: pa.Array, scale: int, dims: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims), scale)


def _sums(kept: DataFrame, centroids: list[tuple[int, ...]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (rows, componentwise sum)}; each task adds up its own rows, a cluster is one row a task."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, counts, sums = Bisectors(centroids), [0] * len(centroids), {}
        for batch in batches:
            x = _matrix(batch.column(0), scale, dims)
            best, _ = planes.nearest(x)
            for k in np.unique(best).tolist():
                part = [int(v) for v in x[best == k].sum(axis=0)]
                counts[k] += int((best == k).sum())
                sums[k] = [a + b for a, b in zip(sums.get(k, [0] * dims), part, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([counts[k] for k in sums], pa.int64()),
             pa.array([[Decimal(v) for v in s] for s in sums.values()], pa.list_(pa.decimal128(38, 0)))],
            names=["cluster", "n", "sums"])

    parts = kept.select("x").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    by_place = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum("part").alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in by_place.collect():  # k * dims rows at most
        n, total = out.setdefault(r["cluster"], (r["n"], [0] * dims))
        total[r["place"]] = int(r["total"])
    return out


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors with exactly ``dims`` components, none null or non-finite, as floor(``scale`` * x). The
    first centroids are the ``k`` vectors whose hash of ``seed`` and id is least (all, if fewer; rows of one id
    by their components). Each round assigns every vector to the nearest centroid, ties to the smaller number, and moves each
    non-empty centroid to the floor of its vectors' exact mean; then vectors are assigned once more. The hash
    is that of the final centroid's components. Sums leave a task as one row a cluster; the driver sees k * dims
    of them, however many the vectors are.

    A null id is clustered like others, repeated rows each. Numbers beyond 64 bits are computed exactly, a distance
    or an inertia that does not fit a long is an error. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    result = "cluster int, distance long"
    kept = materialised(kept_vectors(vectors, dims), "cluster-vectors")
    first = kept.orderBy(hash_order(F.col("vec_id"), seed), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {id_type}, {result}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [tuple(int(v) for v in row) for row in whole(np.array([r["x"] for r in first]), scale)]
    for _ in range(rounds):
        sums = _sums(kept, centroids, scale)
        centroids = [
            tuple(t // sums[i][0] for t in sums[i][1]) if i in sums else c for i, c in enumerate(centroids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Bisectors(centroids)
        for batch in batches:
            best, distance = planes.nearest(_matrix(batch.column(1), scale, dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.int32()), pa.array(distance.tolist(), pa.int64())],
                names=["vec_id", "cluster", "distance"])

    assigned = materialised(kept.mapInArrow(run, f"vec_id {id_type}, {result}"), "cluster-assigned")
    inertia = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    named = spark.createDataFrame(
        [(i, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
         for i, c in enumerate(centroids) if i in inertia],
        "of_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), F.col("cluster") == F.col("of_cluster")).drop("of_cluster")  # k rows at most
