import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kpiloom.llm import near_copies
from tests.llm.conftest import edge_texts, sentence


def shingles(text, k=5):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) or frozenset([tuple(ws)] if ws else [])


def slow_kept(rows):
    """The smallest id of each class, by all pairs of whole shingle sets."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and (a == b or 100 * len(a & b) >= 80 * len(a | b)):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return sorted(set(root.values()))


def varied():
    """Groups of copies with single words changed, most at a similarity of 0.7 to 0.95, some only linked in chains."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        ws = sentence(rng, rng.randint(60, 300)).split()
        for _ in range(rng.choice((2, 3, 12))):
            texts.append(" ".join(ws))
            for _ in range(max(1, len(ws) // 90)):
                ws = list(ws)
                ws[rng.randrange(len(ws))] = "changed" + str(rng.randrange(1000))
    return texts


def test_against_all_pairs(spark, edge_docs):
    rows = list(enumerate(edge_texts()))
    assert sorted(r["doc_id"] for r in near_copies.keep_one(edge_docs).collect()) == slow_kept(rows)
    rows = list(enumerate(varied()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = slow_kept(rows)
    assert 12 <= len(want) < len(rows)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == want


def test_stage_against_all_pairs(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "/root/testdata/sf0.01")
    assert sorted(r["doc_id"] for r in out.collect()) == slow_kept(rows)


def test_same_id_and_null_ids(spark, empty_docs):
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame(
        [(1, base), (1, "quite another text that nothing else replaces"), (2, base + " tail"), (None, base),
         (None, "a text without an id stays"), (2, "x y z"), (2, "x y z")], "doc_id long, text string")
    for parts in (1, 5):
        got = near_copies.keep_one(docs.repartition(parts)).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([
            (1, base), (1, "quite another text that nothing else replaces"), (0, "a text without an id stays"), (2, "x y z")])
    assert near_copies.keep_one(empty_docs).count() == 0


def test_cells_against_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 60), 1 << 60, 9000)
    sets = []
    for i in range(60):
        size = int(rng.choice((1, 3, 40, 300)))
        start = int(rng.integers(0, 5)) * 50 + int(rng.integers(0, 12))
        sets.append(np.unique(base[start : start + size] if i % 9 else rng.integers(0, 99, size)))
    for split in (60, 25, 1, 59):
        i, j = near_copies.similar_pairs(sets, split, 80)
        left, right = range(split), range(split, 60) if split < 60 else range(60)
        want = {(a, b) for a in left for b in right if a < b
                and 100 * len(x := set(sets[a]) & set(sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - len(x))}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
        assert want or split in (1, 59)


def test_group_without_a_hub(spark, monkeypatch):
    """A ring: each text is near only to the next ones, so no text links the group, and blocks are small."""
    monkeypatch.setattr(near_copies, "_BLOCK_NODES", 8)
    rng = random.Random(8)
    ring = sentence(rng, 400).split()
    texts = [" ".join((ring + ring)[4 * i : 4 * i + 100]) for i in range(100)]
    far = [" ".join((ring + ring)[40 * i : 40 * i + 90] + sentence(rng, 60).split()) for i in range(10)]
    rows = list(enumerate(texts + far))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = slow_kept(sorted(rows))
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == want and len(want) <= 11


def test_recall_of_bands(spark):
    """Of all pairs of unequal sets at 0.8 or more at 0.1 scale, how many end in one class: all."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = near_copies.described(docs, 5)
    nodes = rows.groupBy("node").agg(
        F.min("row_key").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")).cache()
    roots = {bytes(r["node"]): bytes(r["root"]) for r in near_copies.links(docs, nodes, 5, 80).collect()}
    sets = {bytes(r["of_node"]): set(r["shingles"]) for r in near_copies.shingle_sets(docs, nodes, 5).collect()}
    held = {}
    for node, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(node)
    common = Counter()
    for nodes_of in held.values():
        if len(nodes_of) > 1:
            common.update((a, b) for k, a in enumerate(nodes_of) for b in nodes_of[:k])
    seen, true, found = set(), 0, 0
    for (a, b), both in common.items():
        key = (min(a, b), max(a, b))
        both += common.get((b, a), 0)
        if key not in seen and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            true += 1
            found += roots.get(a, a) == roots.get(b, b)
        seen.add(key)
    print(f"pairs at 0.8 or more: {true}, in one class: {found}")
    assert true > 40 and found == true


def test_fingerprint_by_majority():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 254, 255, 256, 700):
        held = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        got = near_copies.fingerprint(held)
        bits = [near_copies._bits(held)[:, b].sum() + near_copies._SHARED[b] for b in range(1024)]
        assert [int(got[b // 64]) >> (b % 64) & 1 for b in range(1024)] == [int(2 * c > len(held) + 1) for c in bits]
        assert near_copies._bits(held)[:, :64].tolist() == [[int(h) >> b & 1 for b in range(64)] for h in held]


def test_pairs_that_agree_in_a_piece_meet_in_a_leaf():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 64, (400, near_copies.WORDS), dtype=np.uint64)
    words[200:] = words[:200] ^ (rng.random((200, near_copies.WORDS, 64)) < 0.1).dot(1 << np.arange(64, dtype=object)).astype(np.uint64)
    pieces = np.stack([near_copies._piece(words, p) for p in range(near_copies.PIECES)], axis=1)
    same = pieces[:200] == pieces[200:]
    cuts = near_copies.medians(words)
    assert same.any(axis=1).sum() > 190
    for depth in (0, 3, near_copies.PIECE_BITS - 1):
        leaf = near_copies.leaves_of(words, depth, cuts)
        assert (leaf[:200] == leaf[200:])[same].all() and (leaf >> depth == np.arange(near_copies.PIECES)).all()
    assert len(np.unique(leaf[:, 0])) > 100


def slow_buckets(sets, members):
    """The groups that pairs of ``members`` with close fingerprints connect."""
    words, root = {m: near_copies.fingerprint(sets[m]) for m in members}, {m: m for m in members}
    for a in members:
        for b in members:
            apart = sum(int(x ^ y).bit_count() for x, y in zip(words[a][:2].tolist(), words[b][:2].tolist(), strict=True))
            low, high = sorted((len(sets[a]), len(sets[b])))
            if a < b and apart <= 37 and 100 * low >= 80 * high:
                one, other = sorted((root[a], root[b]))
                root = {k: one if r == other else r for k, r in root.items()}
    return {frozenset(k for k in root if root[k] == r) for r in root.values() if list(root.values()).count(r) > 1}


def test_stage_takes_its_candidates_from_fingerprint_trees(spark, monkeypatch):
    """One leaf a tree, whole or cut into cells: all close pairs meet; no other pair is a candidate."""
    rng = np.random.default_rng(6)
    sets, rows = {}, []
    for k in range(60):
        base = rng.integers(0, 1 << 64, int(rng.integers(20, 90)), dtype=np.uint64)
        for name in range(1 if k % 3 else 4):
            held = np.unique(np.concatenate([base[name:], rng.integers(0, 1 << 64, name, dtype=np.uint64)]))
            sets[node := bytes([k, name]) + bytes(14)] = held
            rows.append((bytearray(node), len(held), near_copies.fingerprint(held).view(np.int64).tolist()))
    rows.append((bytearray(16), 0, []))  # a text without words is never a candidate
    nodes = spark.createDataFrame(rows, "node binary, n int, bands array<long>").repartition(2)
    for cell_rows in (8192, 40):
        monkeypatch.setattr(near_copies, "_CELL_ROWS", cell_rows)
        found = {}
        for r in near_copies.close_buckets(nodes, 80).collect():
            assert r["n"] == len(sets[bytes(r["node"])])
            found.setdefault(r["bucket"], set()).add(bytes(r["node"]))
        want = slow_buckets(sets, list(sets))
        if cell_rows == 8192:
            assert {frozenset(g) for g in found.values()} == want
        joined = {m: {m} for m in sets}
        for g in found.values():
            whole = set().union(*(joined[m] for m in g))
            joined |= dict.fromkeys(whole, whole)
        assert {frozenset(g) for g in joined.values() if len(g) > 1} == want and len(want) >= 20
