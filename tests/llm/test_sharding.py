import zlib

import pytest
from pyspark.sql import functions as F

from kpiloom.llm import queries, sharding
from tests.llm.conftest import edge_texts


def check(rows, n_shards, sizes, tolerance):
    shards = {}
    for doc_id, shard, slot, size in rows:
        assert size == sizes[doc_id]
        shards.setdefault(shard, []).append((slot, size))
    assert all(0 <= s < n_shards for s in shards)
    for found in shards.values():
        assert sorted(s for s, _ in found) == list(range(len(found)))
    loads = [sum(size for _, size in shards.get(s, [])) for s in range(n_shards)]
    mean, largest = sum(loads) / n_shards, max(sizes.values(), default=0)
    assert all(abs(n - mean) <= largest + 2 * tolerance * mean + 1 for n in loads)


@pytest.mark.parametrize("part_bytes", [32 << 20, 3000])
def test_bytes_near_equal(edge_docs, clashing_docs, part_bytes):
    sizes = {i: len((t or "").encode()) + 16 for i, t in enumerate(edge_texts())}
    for frame in (edge_docs, clashing_docs):
        out = sharding.shard(frame, n_shards=6, part_bytes=part_bytes)
        assert {"shard", "shard_slot", "shard_bytes"} | set(frame.columns) == set(out.columns)
        rows = [(r["doc_id"], r["shard"], r["shard_slot"], r["shard_bytes"]) for r in out.collect()]
        assert len(rows) == frame.count()
        check(rows, 6, sizes, 0.005)


def test_hot_text_is_divided_and_others_are_not(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(
            F.concat(F.lit("text "), (F.col("id") / 4).cast("int").cast("string"))).alias("text"))
    rows = sharding.shard(docs, n_shards=10).collect()
    check([(r["doc_id"], r["shard"], r["shard_slot"], r["shard_bytes"]) for r in rows], 10,
          {r["doc_id"]: len(r["text"]) + 16 for r in rows}, 0.005)
    places = {}
    for r in rows:
        places.setdefault(r["text"], set()).add(r["shard"])
    assert len(places["the same text"]) >= 3
    assert sum(len(s) > 1 for s in places.values()) <= 10


def test_empty(empty_docs):
    assert sharding.shard(empty_docs).count() == 0


def test_query(spark):
    rows = queries.op2_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    check([(r["doc_id"], r["shard"], r["slot"], r["size"]) for r in rows], 40,
          {i: len(t.encode()) + 16 for i, t in texts.items()}, 0.005)
