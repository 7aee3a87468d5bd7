import hashlib
import random

from kpiloom.llm import substring_dedup
from tests.llm.conftest import edge_texts


def slow(rows, window=50):
    """(doc_id, n_words, n_removed, sha256) by comparing all windows."""
    first = {}
    split = [((i, t or ""), (t or "").encode().split()) for i, t in rows]
    for (i, _), ws in split:
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            first[key] = min(first.get(key, float("inf")), float("inf") if i is None else i)
    out = set()
    for (i, _), ws in split:
        gone = set()
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p : p + window])] < (float("inf") if i is None else i):
                gone |= set(range(p, p + window))
        kept = [w for p, w in enumerate(ws) if p not in gone]
        out.add((i, len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def got(frame):
    return {tuple(r) for r in substring_dedup.digest(frame).collect()}


def test_edge_cases(edge_docs, clashing_docs):
    want = slow(list(enumerate(edge_texts())))
    assert any(r[2] for r in want)
    assert got(edge_docs) == want
    assert got(clashing_docs) == want
    assert substring_dedup.digest(edge_docs).count() == edge_docs.count()


def test_shared_passages_runs_and_periods(spark):
    rng = random.Random(9)
    vocabulary = ["w%d" % i for i in range(400)] + ["a", "b"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(45, 140))] for _ in range(8)]
    passages += [["a"] * 60, ["a", "b"] * 40, ["a"] * 26 + ["b"] * 26, ["a", "a", "b"] * 30]
    rows = []
    for i in range(150):
        ws = []
        for _ in range(rng.randint(0, 4)):
            ws += [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            ws += p[a : len(p) - rng.randint(0, 10)]
        rows.append((rng.choice((i, i, 400 - i)) * 1000 + i, " ".join(ws)))
    rows += [(None, rows[0][1]), (None, " ".join(passages[0]))]
    want = slow(rows)
    assert sum(r[2] > 0 for r in want) > 50
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want


def test_empty(empty_docs):
    assert substring_dedup.digest(empty_docs).count() == 0
