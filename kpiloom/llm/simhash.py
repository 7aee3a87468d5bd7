"""SimHash near-duplicates through a vantage-point tree that Spark partitions.

Fingerprints that differ in at most 3 of 64 bits agree in at least one half up to 1 bit. Each half is a
metric space of its own: a level of the tree compares the half's Hamming distance to a vantage point with a
median, and by the triangle inequality two halves at distance 1 can fall on different sides only if one is
just below the median and the other on it. Those just below are sent down both sides, so every link meets in
a leaf, and the leaves, which are what Spark partitions by, are searched exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import components, materialised

MAX_BITS = 3
_HALF_BITS = 32
_SPREAD = 0.57  # share of a node's rows in its larger child, boundary rows included


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """One hash per shingle, repeats included; a text of fewer words is one shingle, one without words none."""
    ws = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space are special
    if not ws:
        return np.empty(0, dtype=np.uint64)
    joined = memoryview(b" ".join(ws))
    ends, at = [], -1
    for w in ws:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    spans = zip(starts, ends[shingle - 1 :], strict=False) if len(ws) >= shingle else [(0, ends[-1])]
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int) -> int:
    """A bit is set if it is set in over half the shingles' hashes; without words the fingerprint is 0."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        some = hashes[i : i + 8192]
        bits = np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""
    field = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {field.dataType.simpleString()}, fp long")


def vantage_points(bits: int = _HALF_BITS) -> np.ndarray:
    """31 points of a half at distance 16 from each other, so that their distances say different things:
    bit j of point l is the parity of l AND j. Of fewer ``bits``, as many points less one at about half of them."""
    level, bit = np.arange(1, bits, dtype=np.uint64)[:, None], np.arange(bits, dtype=np.uint64)[None, :]
    parity = np.bitwise_count(level & bit).astype(np.uint64) & np.uint64(1)
    return (parity << bit).sum(axis=1, dtype=np.uint64)


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fps & np.uint64(0xFFFFFFFF), fps >> np.uint64(32)


def medians(sample: np.ndarray) -> np.ndarray:
    """(half, level): the distance that halves the sample most evenly."""
    out = np.full((2, _HALF_BITS - 1), _HALF_BITS // 2)
    if len(sample):
        for h, half in enumerate(_halves(sample)):
            for level, v in enumerate(vantage_points()):
                d = np.bitwise_count(half ^ v)
                below = np.array([(d < m).mean() for m in range(_HALF_BITS + 1)])
                out[h, level] = int(np.abs(below - 0.5).argmin())
    return out


def leaves_of(fps: np.ndarray, depth: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, fingerprint) for every leaf that a fingerprint is sent to."""
    leaves, rows = [], []
    for h, half in enumerate(_halves(fps)):
        at, leaf = np.arange(len(fps)), np.full(len(fps), h, dtype=np.int64)
        for level, v in enumerate(vantage_points()[:depth]):
            d = np.bitwise_count(half[at] ^ v).astype(np.int64)
            cut = cuts[h, level]
            right = d >= cut
            both = np.flatnonzero(d == cut - 1)
            leaf = np.concatenate([leaf * 2 + right, leaf[both] * 2 + 1])
            at = np.concatenate([at, at[both]])
        leaves.append(leaf)
        rows.append(fps[at])
    return np.concatenate(leaves), np.concatenate(rows)


def hang(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hangs the places linked by (a, b) on the smallest place that they reach, in ``root``."""
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for ends in (a, b):
            np.minimum.at(root, root[ends], low)
            np.minimum.at(root, ends, low)
        while (root[root] != root).any():
            root[:] = root[root]
        if (before == root).all():
            break


def leaf_links(fps: np.ndarray, half: int, salt: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) of one leaf, enough to connect what is linked: each block's pairs at distance 3 or less
    hang on the smallest place they reach. A large leaf is divided by a vantage point of its own first."""
    n = len(fps)
    if n > 4096:
        own = _halves(fps)[half]
        d = np.bitwise_count(own ^ own[(salt * 7919) % n]).astype(np.int64)
        cut = max(1, int(np.median(d)))
        left, right = d < cut, d >= cut - 1
        if max(left.sum(), right.sum()) < 0.9 * n:
            yield from leaf_links(fps[left], half, salt + 1)
            yield from leaf_links(fps[right], half, salt + 1)
            return
    root = np.arange(n)
    for i in range(0, n, 512):
        near = np.bitwise_count(fps[i : i + 512, None] ^ fps[None, i:]) <= MAX_BITS
        a, b = np.nonzero(near)
        a, b = a + i, b + i
        hang(root, a[a < b], b[a < b])
    linked = root != np.arange(n)
    if linked.any():
        yield fps[linked], fps[root[linked]]


def links(distinct: DataFrame, leaf_rows: int = 128, sample_rows: int = 4096) -> DataFrame:
    """(a, b): links between fingerprints (column ``fp``, each once) that connect all within 3 bits.

    The depth follows the number of fingerprints; the medians come from at most ``sample_rows`` of them and
    only decide how even the leaves are, never which links are found.
    """
    n = distinct.count()
    depth = min(_HALF_BITS - 1, max(0, math.ceil(math.log(max(n, 1) / leaf_rows) / -math.log(_SPREAD))))
    sample = np.array(
        [r.fp for r in distinct.orderBy(F.xxhash64(F.lit(1), "fp")).limit(sample_rows).collect()] if depth else [],
        dtype=np.int64).view(np.uint64)
    cuts = medians(sample)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 4096):
                leaf, fp = leaves_of(fps[i : i + 4096], depth, cuts)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fp.view(np.int64))], names=["leaf", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_leaf = [], None
        out_a, out_b, waiting = [], [], 0

        def close() -> None:
            nonlocal waiting
            if held_leaf is not None:
                fps = np.concatenate(held)
                if len(fps) > 1:
                    for a, b in leaf_links(fps, int(held_leaf >> depth)):
                        out_a.append(a)
                        out_b.append(b)
                        waiting += len(a)

        def flush() -> pa.RecordBatch:
            a = np.concatenate(out_a) if out_a else np.empty(0, np.uint64)
            b = np.concatenate(out_b) if out_b else np.empty(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            leaf = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(leaf):
                continue
            edges = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)]])
            for i, j in zip(edges, edges[1:], strict=False):
                if leaf[i] != held_leaf:
                    close()
                    held, held_leaf = [], leaf[i]
                held.append(fp[i:j].copy())
            if waiting > 50_000:
                yield flush()
                out_a, out_b, waiting = [], [], 0
        close()
        yield flush()

    routed = distinct.select("fp").mapInArrow(route, "leaf long, fp long")
    return routed.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(search, "a long, b long").distinct()


def classes(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document: component_id is the smallest doc_id that links reach.

    Equal fingerprints are counted once before the search, so copies cost nothing there; a fingerprint that
    a third of all rows share is a hot key only in the last join, which Spark splits. Null and empty texts
    have fingerprint 0 and link like others. Null ids are never the smallest unless a component has no
    other, which then has a null component_id. Repeated rows get the same answer. An empty table gives none.
    """
    printed = materialised(with_fingerprints(docs, shingle), "simhash-docs")
    distinct = materialised(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    roots = components(links(distinct), "simhash-links")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialised(
        rooted.join(smallest, "root").select(F.col("fp").alias("of_fp"), "component_id"), "simhash-classes")
    return printed.join(named, printed["fp"] == named["of_fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, the one with the smallest id. Rows without an
    id can't be told apart and all stay; of repeated rows one stays."""
    kept = classes(docs, shingle).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).union(docs.where("doc_id is null"))
