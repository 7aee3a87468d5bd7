"""License scans: notices and identifier tags found by one Aho-Corasick automaton over a text's words, and the
license expressions that follow tags, read by a shunting-yard parser and evaluated."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"),
)

#: Further notices, as words that stand one after the other.
NOTICES = (
    ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"), ("bsd license", "bsd"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"),
    ("isc license", "isc"), ("eclipse public license", "epl"), ("creative commons zero", "cc0"),
    ("creative commons attribution", "cc-by"), ("cc by nc", "cc-by-nc"), ("cc by nd", "cc-by-nd"),
    ("cc by sa", "cc-by-sa"), ("cc0", "cc0"), ("public domain", "public-domain"),
    ("permission is hereby granted free of charge", "mit"), ("all rights reserved", "reserved"),
)

#: Words after which an expression may follow.
TAGS = ("spdx license identifier", "license identifier", "license expression")

#: How freely a text under a label may be used, from 0 (not) to 1 (freely). Names are matched by their first parts.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "apache": 0.9, "zlib": 0.9,
    "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2,
    "cc-by-nc": 0.1, "reserved": 0.0,
}
UNKNOWN = 0.5  # of a text without a license, and of a name that is not listed
EXCEPTION = 0.2  # what an exception to a license adds

_OPERATORS = {"or": 1, "and": 2, "with": 3}
_TAG = re.compile(r"(?i)licen[sc]e[ _-](?:identifier|expression)[ \t]*[:=][ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
#: Bytes of a word are kept, A-Z in lower case, all others become spaces; bytes over 0x7F are of words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Scan:
    n_words: int
    starts: tuple[int, ...]
    base_labels: tuple[str, ...]
    labels: tuple[str, ...]
    expressions: tuple[str, ...]
    score: float


def label_of(name: str) -> str:
    """The label that a license name's first parts are, the longest one; else the name itself in lower case."""
    name = name.lower().rstrip("+.")
    parts = name.split("-")
    for n in range(len(parts), 0, -1):
        if "-".join(parts[:n]) in FREEDOM:
            return "-".join(parts[:n])
    return name


def postfix(text: str) -> list[str] | None:
    """The tokens of a license expression, operators after what they join: with binds before and, and before or.
    None if it is no whole expression."""
    out, waiting, operand_next = [], [], True
    for token in _TOKEN.findall(text):
        low = token.lower()
        if low in _OPERATORS:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _OPERATORS[waiting[-1]] >= _OPERATORS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(tokens: Sequence[str]) -> tuple[float, set[str]]:
    """(freedom, labels) of an expression in postfix form: of alternatives the freest, of conditions the
    strictest; an exception frees a little and is no label."""
    stack: list[tuple[float, set[str]]] = []
    for token in tokens:
        if token in _OPERATORS:
            (b, right), (a, left) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((min(1.0, a + EXCEPTION), left))
            else:
                stack.append(((max if token == "or" else min)(a, b), left | right))
        else:
            label = label_of(token)
            stack.append((FREEDOM.get(label, UNKNOWN), {label}))
    return stack[0]


@cache
def _automaton():
    """All phrases with a space at both ends, so that only whole words match, overlapping ones too."""
    import ahocorasick

    found: dict[str, list[tuple[str, str]]] = {}
    for phrases, kind in ((BASE, "base"), (NOTICES, "notice"), ([(t, "") for t in TAGS], "tag")):
        for phrase, label in phrases:
            found.setdefault(f" {phrase} ", []).append((kind, label))
    automaton = ahocorasick.Automaton()
    for phrase, meanings in found.items():
        automaton.add_word(phrase, (len(phrase), meanings))
    automaton.make_automaton()
    return automaton


def scan_text(text: str | None) -> Scan:
    ws = (text or "").encode().translate(_WORD_BYTES).split()
    joined = f" {b' '.join(ws).decode('latin-1')} "  # one character a byte: only ASCII phrases are sought
    places, labels, tagged = [], set(), False
    for end, (length, meanings) in _automaton().iter(joined):
        for kind, label in meanings:
            if kind == "tag":
                tagged = True
            else:
                labels.add(label)
                if kind == "base":
                    places.append((end - length + 1, label))
    starts, at, word = [], 0, 0
    for place, _ in sorted(places):
        word += joined.count(" ", at, place)
        at = place
        starts.append(word)
    freedom = [FREEDOM[x] for x in labels]
    expressions = []
    for found in _TAG.findall(text or "") if tagged else ():
        tokens = postfix(found)
        if tokens is None:  # no whole expression: all the names in it hold
            names = [t for t in _TOKEN.findall(found) if t.lower() not in _OPERATORS and t not in "()"]
            values = [(FREEDOM.get(x, UNKNOWN), {x}) for x in map(label_of, names) if x in FREEDOM]
        else:
            values = [evaluate(tokens)]
            expressions.append(" ".join(tokens))
        for value, names in values:
            freedom.append(value)
            labels |= names
    return Scan(len(ws), tuple(starts), tuple(sorted({x for _, x in places})), tuple(sorted(labels)),
                tuple(expressions), min(freedom, default=UNKNOWN))


_ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, score double"
_NAMES = tuple(f.split(" ")[0] for f in _ADDED.split(", "))


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with what its license notices say (columns of the added names are replaced).

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are the least and greatest word
    they start at (null if none); ``labels`` adds those of further notices and of the names in tagged expressions,
    which ``expressions`` lists in postfix form. ``score`` is the least freedom of all that was found, 0.5 if
    nothing was. Texts are scanned whole, where they are read, one at a time.

    Null text counts as empty: no words, no labels. Repeated rows are each scanned. An empty table gives none.
    """
    kept = [c for c in docs.columns if c not in _NAMES]
    rows = docs.select(F.struct(*kept).alias("row"), F.col("text").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py()) for t in batch.column(1)]
            columns = [
                pa.array([s.n_words for s in found], pa.int64()), pa.array([len(s.starts) for s in found], pa.int64()),
                pa.array([s.starts[0] if s.starts else None for s in found], pa.int64()),
                pa.array([s.starts[-1] if s.starts else None for s in found], pa.int64()),
                pa.array([",".join(s.base_labels) for s in found], pa.string()),
                pa.array([",".join(s.labels) for s in found], pa.string()),
                pa.array([list(s.expressions) for s in found], pa.list_(pa.string())),
                pa.array([s.score for s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", *_NAMES])

    row = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {row}, {_ADDED}").select(*[F.col("row")[c].alias(c) for c in kept], *_NAMES)
