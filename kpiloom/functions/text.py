"""Header, name and formula text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Fixed value: the marker an interview reply carries when all items are confirmed.
COMPLETION_MARKER = "[INTERVIEW_COMPLETE]"

IDENTIFIER = r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"


def normalise_header(name: str) -> str:
    """Lower-case header with every run of non-word characters as one underscore."""
    return re.sub(r"[\W_]+", "_", name.strip().lower()).strip("_")


def normalise_headers(names: list[str]) -> list[str]:
    """Unique, non-empty column names in file order.

    A repeated name takes the next number of its own count (``c, c_1, c_2``). Where that
    number is another header's name, counting goes on, and a header of punctuation alone
    becomes ``column``.
    """
    taken: set[str] = set()
    repeats: dict[str, int] = {}
    result = []
    for raw in names:
        base = normalise_header(raw) or "column"
        name = base
        while name in taken:
            repeats[base] = repeats.get(base, 0) + 1
            name = f"{base}_{repeats[base]}"
        taken.add(name)
        result.append(name)
    return result


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def extension(filename: Column) -> Column:
    """Lower-cased last extension with its dot, empty when the name has no dot."""
    return F.when(
        filename.contains("."),
        F.concat(F.lit("."), F.lower(F.element_at(F.split(filename, r"\."), -1))),
    ).otherwise("")


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def chart_title(name: Column, dimension: Column | None = None) -> Column:
    if dimension is None:
        return title(name)
    return F.concat(title(name), F.lit(" by "), dimension)


def formula_identifiers(formula: Column) -> Column:
    """Every identifier of a formula in order, the name before ``=`` included."""
    return F.regexp_extract_all(formula, F.lit(IDENTIFIER), F.lit(0))


def transcript_line(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", "User").otherwise("Assistant"), F.lit(": "), text)


def has_completion_marker(reply: Column) -> Column:
    return reply.contains(COMPLETION_MARKER)


def without_completion_marker(reply: Column) -> Column:
    cleared = F.replace(reply, F.lit(COMPLETION_MARKER), F.lit(""))
    return F.regexp_replace(cleared, r"^\s+|\s+$", "")
