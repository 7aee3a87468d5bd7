import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from kpiloom.llm import queries, secrets
from tests.llm.conftest import edge_texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def slow_entropy(value, window, bits):
    high = []
    for i in range(len(value) - window + 1):
        part = value[i : i + window]
        h = -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part))
        if h >= bits:
            if high and high[-1][1] >= i:
                high[-1][1] = i + window
            else:
                high.append([i, i + window])
    return [tuple(h) for h in high]


def test_base_spans(edge_docs, clashing_docs):
    for frame in (edge_docs, clashing_docs):
        out = secrets.scan(frame)
        assert set(out.columns) == set(frame.columns) | {"secret_spans"}
        rows = out.collect()
        assert len(rows) == frame.count()
        for r in rows:
            spans = [tuple(s) for s in r["secret_spans"]]
            assert spans == sorted(spans)
            assert [s for s in spans if s[2] != "entropy"] == base_spans(edge_texts()[r["doc_id"]])


def test_entropy_windows(spark):
    values = ["a" * 50, "abc123" * 8, "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "aaaaaaaaaaaaaaaaaaaaaaaaZx9QpL3vB7nM2kR8tY5waaaaaaaaaaaaaaaaaaaaaaaaaaZx9QpL3vB7nM2kR8tY5w",
              "Zx9QpL3vB7nM2kR8tY5w", "short1"]
    for window, bits in ((20, 3.6), (24, 3.0), (5, 2.0)):
        frame = spark.createDataFrame([(v,) for v in values], "v string")
        for r in frame.select("v", secrets.entropy_spans(F.col("v"), window, bits).alias("s")).collect():
            assert [tuple(x) for x in r["s"]] == slow_entropy(r["v"], window, bits), r["v"]


@pytest.mark.parametrize("text, found", [
    ("key Zx9QpL3vB7nM2kR8tY5wQ1 end", ["4:26"]),
    ("id 123e4567-e89b-12d3-a456-426614174000 end", []),
    ("see /usr/local/share/icons/default/file and alpha-beta-gamma-delta-2024", []),
    ("ThisIsAVeryLongIdentifierName2 ababab1ababab1ababab1ababab1", []),
    ("2024-01-01_2024-01-02_2024-01-03", []),
])
def test_allow_list(spark, text, found):
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [f"{s['start']}:{s['end']}" for s in row["secret_spans"] if s["kind"] == "entropy"] == found


def test_redact(spark, edge_docs):
    text = 'x password = "hunter22" é \U0001f600 deadbeefdeadbeefdeadbeef y token=deadbeefdeadbeefdeadbeef'
    out = secrets.redact(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string"))
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == [
        'x [SECRET]" é \U0001f600 [SECRET] y [SECRET]', "plain", None]
    masked = secrets.redact(edge_docs).cache()
    assert masked.count() == edge_docs.count()
    again = secrets.scan(masked).where(F.size("secret_spans") > 0)
    assert again.count() == 0


def test_query(spark, empty_docs):
    rows = queries.op9_secrets(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        want = base_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, _, x, _ in want) for k in ("assign", "access", "hex"))
    assert len(rows) == len(texts)
    assert secrets.scan(empty_docs).count() == 0


def slow_candidate_spans(value):
    def readable(v):
        return not (re.search("[0-9]", v) and re.search("[A-Za-z]", v)) or any(re.search(p, v) for p in secrets.ALLOWED)

    at = set()
    for c in () if readable(value) else secrets.CLASSES:
        for m in re.finditer(c.pattern, value):
            if not readable(m[0]):
                for a, b in slow_entropy(m[0], c.window, c.bits):
                    at |= set(range(m.start() + a, m.start() + b))
    return at


def test_runs_inside_candidates(spark):
    """Upper-case hex joined to a name or path is covered as it is alone, whatever stands before it."""
    rng = random.Random(4)
    texts = []
    for i in range(60):
        value = "".join(rng.choices("0123456789ABCDEF", k=rng.choice((20, 23, 40, 64))))
        texts.append(("", "KEY=", "/", "session-id=", "a/b/SIG=")[i % 5] + value + ("", "-end", "/x")[i % 3])
    texts += ["order-12345678901234567890-x1", "path/to/averylongwordwithoutanydigit2/file"]
    texts += ["".join(rng.choices("ab01XYZ9=/-_+", k=rng.randint(20, 90))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(f"see {t} end" for t in texts)), "doc_id long, text string")
    covered = 0
    for r in secrets.scan(frame).collect():
        spans = [s for s in r["secret_spans"] if s["kind"] == "entropy"]
        got = {x - 4 for s in spans for x in range(s["start"], s["end"])}
        assert all(x["end"] < y["start"] for x, y in zip(spans, spans[1:]))
        assert got == slow_candidate_spans(texts[r["doc_id"]]), texts[r["doc_id"]]
        hexes = {x for m in re.finditer("[0-9A-F]{20,}", texts[r["doc_id"]]) for x in range(*m.span())}
        covered += r["doc_id"] < 60 and len(hexes & got) >= 0.9 * len(hexes)
    assert covered >= 54


def test_long_candidates_and_many_matches(spark):
    """100,000 random characters are one candidate; 10,000 matches in one text."""
    rng = random.Random(9)
    blob = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=100_000))
    path = "/".join("ab1" if i % 500 == 0 else "word" for i in range(20_000))
    docs = spark.createDataFrame([(1, f"x {blob} y"), (2, path)], "doc_id long, text string")
    began = time.monotonic()
    first, second = secrets.scan(docs).orderBy("doc_id").collect()
    assert time.monotonic() - began < 20
    at = set()
    for s in first["secret_spans"]:
        if s["kind"] == "entropy":
            at |= set(range(s["start"] - 2, s["end"] - 2))
    assert at == slow_candidate_spans(blob)
    assert [tuple(s) for s in first["secret_spans"] if s["kind"] != "entropy"] == base_spans(f"x {blob} y")
    assert not second["secret_spans"]

    text = " é ".join(f"token={i:06x}{i * 7:06x} plain" for i in range(10_000))
    began = time.monotonic()
    got = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert time.monotonic() - began < 20
    assert got == " é ".join("[SECRET] plain" for _ in range(10_000))
