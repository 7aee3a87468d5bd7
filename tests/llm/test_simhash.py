import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kpiloom.llm import simhash
from kpiloom.llm.common import components
from tests.llm.conftest import edge_texts


def slow_fingerprint(text, k=3):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    shingles = [b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or ([b" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_classes(fps):
    """fingerprint -> set linked with it, by all pairs."""
    todo, out = set(fps), {}
    while todo:
        group, front = set(), {todo.pop()}
        while front:
            group |= front
            front = {x for x in todo if any((x ^ y).bit_count() <= 3 for y in front)}
            todo -= front
        out |= dict.fromkeys(group, group)
    return out


def expected(rows):
    fps = {(i, t): slow_fingerprint(t) for i, t in rows}
    groups = slow_classes(set(fps.values()))
    least = {f: min(i for (i, _), g in fps.items() if g in groups[f]) for f in groups}
    return {(i, fps[i, t], least[fps[i, t]]) for i, t in rows}


def test_classes(edge_docs, clashing_docs):
    rows = list(enumerate(edge_texts()))
    for frame in (edge_docs, clashing_docs):
        got = simhash.classes(frame).collect()
        assert len(got) == frame.count()
        assert {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got} == expected(rows)


def test_spark_hash_is_the_same(spark, edge_docs):
    one = edge_docs.select(F.xxhash64("text").alias("h"), "text").where("text is not null").collect()
    assert all(r["h"] % (1 << 64) == xxhash.xxh64_intdigest(r["text"].encode(), 42) for r in one)


def test_links_find_every_class(spark):
    """Chains, clusters and far fingerprints, with a tree deep enough to divide them."""
    rng = random.Random(5)
    fps = {0, 7, 1 << 63}
    for _ in range(300):
        fp = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 1, 4, 40))):
            fps.add(fp)
            for _ in range(rng.randint(1, 4)):
                fp ^= 1 << rng.randrange(64)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in components(simhash.links(frame, leaf_rows=8), "test").collect()}
    roots |= {r % (1 << 64): r for r in roots.values()}
    want = slow_classes(fps)
    assert set(roots) == {f for f, g in want.items() if len(g) > 1}
    for f, root in roots.items():
        assert {g for g in roots if roots[g] == root} == want[f]


def test_large_leaf_divides_itself():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    fps[1::2] = fps[::2] ^ (np.uint64(1) << rng.integers(0, 32, 3000).astype(np.uint64))
    found = {frozenset((int(a), int(b))) for x, y in simhash.leaf_links(fps, 0) for a, b in zip(x, y)}
    assert {frozenset((int(a), int(b))) for a, b in zip(fps[::2], fps[1::2])} <= found


def test_keep_one(edge_docs):
    kept = [r["doc_id"] for r in simhash.keep_one(edge_docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in expected(list(enumerate(edge_texts())))})


def test_null_ids_and_empty(spark, empty_docs):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "q r s t u")], "doc_id long, text string")
    assert sorted((r["component_id"] or 0) for r in simhash.classes(docs).collect()) == [0, 4, 4]
    assert simhash.keep_one(docs).count() == 3
    assert simhash.classes(empty_docs).count() == 0
    assert simhash.keep_one(empty_docs).count() == 0
