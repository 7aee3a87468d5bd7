import random
import re

import pytest

from kpiloom.llm import licenses, queries
from tests.llm.conftest import edge_texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow_base(text):
    """(n_words, n_base, first, last, labels) by looking at every word."""
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in licenses.BASE:
        p = phrase.split(" ")
        found += [(i, label) for i in range(len(ws)) if ws[i : i + len(p)] == p]
    at = sorted(i for i, _ in found)
    return len(ws), len(found), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in found}))


def made_texts():
    rng = random.Random(12)
    parts = ["GNU General Public License", "apache license", "Apache", "license", "CC BY", "CC-BY-NC 4.0", "cc", "by", "MIT License", "mit",
             "xmit license", "mit licensed", "cc by cc by", "Ünï", "\n", "<b>", "SPDX-License-Identifier: MIT OR GPL-2.0-only\n", "w" * 40, "é cc by é", "cc\x7fby"]
    return ["".join(rng.choice(parts) + rng.choice((" ", "", "-", ". ", "\t")) for _ in range(rng.randint(0, 30))) for _ in range(300)]


def check(rows, texts):
    for r in rows:
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        assert got == slow_base(texts[r["doc_id"]]), texts[r["doc_id"]]
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels)
        assert 0 <= r["score"] <= 1


def test_base_against_every_word(spark, edge_docs, clashing_docs, empty_docs):
    texts = made_texts() + ["cc by " * 20_000, "Licensed under the Apache License, Version 2.0 and the MIT license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    for frame in (edge_docs, clashing_docs):
        out = licenses.scan(frame)
        assert set(out.columns) == set(frame.columns) | set(licenses._NAMES)
        rows = out.collect()
        assert len(rows) == frame.count()
        check(rows, edge_texts())
    assert licenses.scan(empty_docs).count() == 0


@pytest.mark.parametrize("text, want", [
    ("MIT", "MIT"), ("MIT OR Apache-2.0", "MIT Apache-2.0 or"), ("A AND B OR C", "A B and C or"), ("A OR B AND C", "A B C and or"),
    ("(A OR B) AND C", "A B or C and"), ("GPL-2.0 WITH X AND B", "GPL-2.0 X with B and"), ("A or B or C", "A B or C or"),
    ("((A))", "A"), ("A B", None), ("A AND", None), ("OR A", None), ("(A", None), ("A)", None), ("", None), ("()", None),
])
def test_shunting_yard(text, want):
    assert licenses.postfix(text) == (want.split(" ") if want else None)


def recursive(tokens):
    """Value of an expression by recursive descent."""
    def alternatives():
        value = conditions()
        while tokens and tokens[0] == "OR":
            tokens.pop(0)
            value = max(value, conditions())
        return value

    def conditions():
        value = excepted()
        while tokens and tokens[0] == "AND":
            tokens.pop(0)
            value = min(value, excepted())
        return value

    def excepted():
        value = single()
        if tokens and tokens[0] == "WITH":
            tokens.pop(0)
            tokens.pop(0)
            value = min(1.0, value + licenses.EXCEPTION)
        return value

    def single():
        token = tokens.pop(0)
        if token == "(":
            value = alternatives()
            tokens.pop(0)
            return value
        return licenses.FREEDOM.get(licenses.label_of(token), licenses.UNKNOWN)

    return alternatives()


def test_evaluation_against_recursive_descent():
    rng = random.Random(4)
    names = ["MIT", "GPL-3.0-or-later", "Apache-2.0", "CC-BY-NC-4.0", "LGPL-2.1+", "Odd-1.0", "CC0-1.0"]

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(names)] + (["WITH", "Some-exception"] if rng.random() < 0.2 else [])
        inner = made(depth - 1) + [rng.choice(("AND", "OR"))] + made(depth - 1)
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(300):
        tokens = made(4)
        value, _ = licenses.evaluate(licenses.postfix(" ".join(tokens)))
        assert value == recursive(tokens)
    deep = "(" * 50_000 + "MIT" + ")" * 50_000
    assert licenses.evaluate(licenses.postfix(deep)) == (0.9, {"mit"})


@pytest.mark.parametrize("text, labels, score", [
    ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nint main", "gpl", 0.5),
    ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND CC-BY-4.0", "cc-by,gpl,mit", 0.8),
    ("SPDX-License-Identifier: MIT and (oops", "mit", 0.9),
    ("Licensed under CC BY-NC 4.0.\nText", "cc-by,cc-by-nc", 0.1),
    ("GNU Lesser General Public License", "lgpl", 0.5), ("plain text", "", 0.5), (None, "", 0.5),
    ("License expression without a colon MIT", "", 0.5), ("Copyright X. All rights reserved.", "reserved", 0.0),
])
def test_labels_and_score(text, labels, score):
    got = licenses.scan_text(text)
    assert (",".join(got.labels), got.score) == (labels, score)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_licenses(spark, sf).collect()
    assert len(rows) == len(texts) and any(r["n_base"] for r in rows)
    check(rows, texts)
