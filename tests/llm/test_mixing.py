import math

import pytest
from pyspark.sql import functions as F

from kpiloom.llm import mixing
from tests.llm.conftest import edge_texts


def expected_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Shares by weight, the excess over a cap handed on until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_sources, left = {}, set(order), share * sum(sizes.values())
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        over = [s for s in open_sources if left * weight[s] / total >= cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_sources}
        for s in over:
            target[s] = cap * sizes[s]
            open_sources.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


def words(t):
    return len((t or "").encode().split())


def test_targets_and_words_taken(edge_docs):
    rows = mixing.assign(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    sizes = {}
    for r in rows:
        assert r["size"] == words(edge_texts()[r["doc_id"]])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want, taken = expected_targets(sizes), {}
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum(p["words"] for p in r["placements"])
        assert all(0 <= p["position"] <= 1 for p in r["placements"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    again = {(r["doc_id"], r["taken"], str(r["placements"])) for r in mixing.assign(edge_docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"], str(r["placements"])) for r in rows}


def test_due_time_inverts_the_integral(spark):
    schedule = ((0.0, 0.2), (0.3, 1.0), (0.6, 1.0), (1.0, 0.0))

    def integral(t):
        area = 0.0
        for (a, r0), (b, r1) in zip(schedule, schedule[1:]):
            x = min(max(t - a, 0), b - a)
            area += r0 * x + (r1 - r0) / (b - a) * x * x / 2
        return area

    rows = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", mixing.due_time(F.col("u"), schedule).alias("t"))
    for u, t in rows.collect():
        assert integral(t) / integral(1) == pytest.approx(u, abs=1e-9)


def test_mix_repeats_and_cuts(edge_docs, clashing_docs):
    plan = {r["doc_id"]: r for r in mixing.assign(edge_docs).collect()}
    for frame in (edge_docs, clashing_docs):
        out = mixing.mix(frame)
        rows = out.collect()
        assert set(out.columns) == set(frame.columns) | {"mix_copy", "mix_position"}
        got = {}
        for r in rows:
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + words(r["text"])
            assert edge_texts()[r["doc_id"]].encode().split()[: words(r["text"])] == r["text"].encode().split()
        for doc_id, n in got.items():
            if doc_id != 6:  # the repeated row follows one plan twice
                assert n == plan[doc_id]["taken"]
        places = [r["mix_position"] for r in rows]
        assert places == sorted(places)


def test_fading_in(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"),
        F.when(F.col("id") % 2 == 0, "s0").otherwise("s2").alias("source"))
    rows = mixing.assign(docs, weights=(1,), schedules=(((0, 0), (1, 2)), ((0, 2), (1, 0)))).collect()
    mean = {s: [p["position"] for r in rows if r["source"] == s for p in r["placements"]] for s in ("s0", "s2")}
    assert math.fsum(mean["s0"]) / len(mean["s0"]) > 0.6 > 0.4 > math.fsum(mean["s2"]) / len(mean["s2"])


def test_empty(empty_docs):
    assert mixing.assign(empty_docs).count() == 0
    assert mixing.mix(empty_docs).count() == 0
