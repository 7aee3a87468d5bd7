import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kpiloom.llm import packing
from kpiloom.llm.queries import TOKENIZER
from tests.llm.conftest import edge_texts, sentence


PLAIN = Tokenizer.from_file(TOKENIZER)
PLAIN.encode_special_tokens = True
ENCODER = packing.Encoder(TOKENIZER)


def slow_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, ids_of, tiers=(256, 512, 1024, 2048)):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc_id, pieces in docs.items():
        pieces.sort(key=lambda r: r["start"])
        want, at = ids_of[doc_id], 0
        for r in pieces:
            assert r["doc_tokens"] == len(want)
            at %= len(want)  # a repeated row starts again
            if r["start"] == at:
                assert np.frombuffer(r["ids"], "<u4").tolist() == want[at : at + r["length"]]
                at += r["length"]
    short = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        short += at not in tiers
    return docs, short


def test_every_id_once(edge_docs, clashing_docs):
    ids = {i: slow_ids(t) for i, t in enumerate(edge_texts())}
    for frame in (edge_docs, clashing_docs):
        rows = packing.pack(frame, TOKENIZER).collect()
        docs, short = check(rows, ids)
        assert short <= frame.rdd.getNumPartitions()
        assert {d: sum(r["length"] for r in ps) for d, ps in docs.items()} == {
            d: len(x) * (2 if d == 6 else 1) for d, x in ids.items()}


def test_flushes():
    pool, n, windows = packing.Pool(), 0, []
    rng = random.Random(1)
    for i in range(400):
        length = rng.randint(1, 2047)
        pool.add((i, 0, length))
        n += length
        if i % 50 == 49:
            windows += list(packing.pack_pieces(pool, (256, 512, 1024, 2048)))
    windows += list(packing.last_windows(pool, (256, 512, 1024, 2048)))
    assert sum(p[2] for _, ps in windows for p in ps) == n
    assert all(sum(p[2] for p in ps) == tier for tier, ps in windows if tier)
    assert sum(not tier for tier, _ in windows) <= 1


def test_step_groups(spark):
    """Over 8 tasks, every group but the last of a tier has the same number of windows, all of one length."""
    rng = random.Random(6)
    docs = spark.createDataFrame(
        [(i, sentence(rng, rng.choice((3, 60, 200, 900)))) for i in range(600)], "doc_id long, text string").repartition(8)
    groups, short = {}, 0
    for r in packing.pack(docs, TOKENIZER, step_tokens=8192).collect():
        groups.setdefault(r["tier"], {}).setdefault(r["step_group"], {}).setdefault(r["sequence_id"], []).append(r["length"])
    assert len(groups) > 3
    for tier, of_tier in groups.items():
        sizes = [len(windows) for _, windows in sorted(of_tier.items())]
        if tier == 0:
            assert sizes == [1] * len(sizes) and len(sizes) <= 8
            continue
        assert all(sum(w) == tier for windows in of_tier.values() for w in windows.values())
        assert sizes[:-1] == [8192 // tier] * (len(sizes) - 1) and sizes[-1] <= 8192 // tier
        short += sizes[-1] < 8192 // tier
    assert short <= 4


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'sé1.#  \n\t\u00a0\u2003\u0085\x1c世<|>")), max_size=40))
def test_encoder_equals_tokenizer(text):
    got = ENCODER.encode([text, "shared words", text])
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [slow_ids(t)[:-1] for t in (text, "shared words", text)]


def test_long_runs():
    rng = random.Random(2)
    for text in (" " * 200_000, "x" + "\n" * 50_000 + "y", "a" * 100_000, "".join(rng.choices("abé1.", k=50_000)), sentence(rng, 30_000)):
        assert np.frombuffer(ENCODER.one(text), "<u4").tolist() == slow_ids(text)[:-1]


def test_other_vocabularies():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = packing.Encoder(path), Tokenizer.from_file(path)
    assert encoder.ranked is None
    assert np.frombuffer(encoder.one("Some Words, here"), "<u4").tolist() == plain.encode("Some Words, here", add_special_tokens=False).ids


def test_empty(empty_docs):
    assert packing.pack(empty_docs, TOKENIZER).count() == 0
