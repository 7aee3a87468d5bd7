"""Secret scans: known patterns, and sliding windows of high Shannon entropy over candidate strings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, and the least length of the value they must find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

_BLOCK = 64  # values of a list that are joined one by one
_CHUNK = 1024  # code points

#: Candidates that are no secrets although their letters are mixed: UUIDs, paths of readable words, dotted or
#: dashed words and dates, and one character or pair repeated. Groups are possessive, so that a match of any
#: length runs in a loop.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/*+(?:[a-z_-]++/++)++[a-z0-9_-]{0,15}+/?$",
    r"^(?:[A-Za-z]++|[0-9]++)(?:[-_=/+]++(?:[A-Za-z]++|[0-9]{1,8}+))++[-_=/+]*$",
    r"^(.{1,2})\1+$",
    r"^[A-Za-z]+[0-9]{0,4}$",
    r"^[0-9_=/+-]+$",
)


@dataclass(frozen=True)
class CharClass:
    """A set of characters, the window slid over each maximal run of them inside a candidate and the entropy
    that is too high for text (bits per character; a window of n characters has log2(n) at most)."""

    pattern: str
    window: int
    bits: float


CLASSES = (
    CharClass(r"[0-9a-fA-F]+", 20, 3.0),
    CharClass(r"[A-Za-z0-9]+", 20, 3.6),
    CharClass(r"[A-Za-z0-9+/_=-]+", 20, 3.8),
)


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches and the texts between them; without a match both are null."""
    any_match = text.rlike(pattern)
    return (F.when(any_match, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
            F.when(any_match, F.split(text, pattern, -1)))


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: inside a lambda an expression runs anew at each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _before(values: Column, first: int, join: Callable[[Column, Column], Column]) -> Column:
    """For every place of ``values`` (array of int) what ``join`` makes of ``first`` and the values before it.
    Blocks are joined first, so that the work grows with the length and not with its square."""
    zero = F.lit(first)

    def of_blocks(v: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(
            F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)), zero, join))
        starts = F.aggregate(whole, F.array(zero), lambda out, x: F.concat(out, F.array(join(F.get(out, F.size(out) - 1), x))))
        return _with(starts, lambda at: F.transform(v, lambda x, i: F.aggregate(
            F.slice(v, i - i % _BLOCK + 1, i % _BLOCK), F.get(at, F.floor(i / _BLOCK).cast("int")), join)))

    return F.when(F.size(values) > 0, _with(values, of_blocks)).otherwise(F.array().cast("array<int>"))


def _spans(found: Column, gaps: Column) -> Column:
    """(start, end, value) of each match, in code points, from the lengths before it."""
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(
        v.alias("value"), F.length(g).alias("gap"), (F.length(g) + F.length(v)).alias("length")))
    starts = lambda ps: _before(F.transform(ps, lambda p: p["length"]), 0, lambda a, b: a + b)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.coalesce(_with(pairs, lambda ps: F.zip_with(ps, starts(ps), lambda p, at: F.struct(
        (at + p["gap"]).alias("start"), (at + p["length"]).alias("end"), p["value"].alias("value")))), empty)


def _weight(n: Column) -> Column:
    """n log2 n in units of 2^-40 bits: whole numbers, so that a long sum of changes stays exact."""
    return F.when(n > 1, F.round(n * F.log2(n.cast("double")) * float(1 << 40))).otherwise(F.lit(0.0)).cast("long")


def entropy_spans(value: Column, window: int, bits: float) -> Column:
    """Unions of overlapping windows of ``value`` (ASCII) whose entropy reaches ``bits``: (start, end).

    The window moves by one character at a time and keeps the sum of n log2 n over the counts of its characters,
    from which entropy is log2(window) - sum / window. A step changes two counts: those of the character that
    leaves and of the one that enters, both counted among the characters that stay.
    """
    weights = F.array(*[_weight(F.lit(n)) for n in range(window + 1)])

    def changes(codes: Column, weight: Column) -> Column:
        def change(enters: Column, at: Column) -> Column:
            first = F.greatest(at - (window - 1), F.lit(0))

            def counted(stay: Column) -> Column:
                def gain(code: Column) -> Column:
                    return _with(F.size(F.filter(stay, lambda x: x == code)), lambda n: F.get(weight, n + 1) - F.get(weight, n))

                leaves = F.when(at >= window, gain(F.get(codes, at - window))).otherwise(F.lit(0).cast("long"))
                return gain(enters) - leaves

            return _with(F.slice(codes, first + 1, at - first), counted)

        return F.transform(codes, change)

    least = F.floor((F.log2(F.lit(float(window))) - bits) * float(window) * float(1 << 40)).cast("long")

    def step(state: Column, change: Column) -> Column:
        total, end = state["sum"] + change, state["at"] + 1
        return F.struct(
            end.alias("at"), total.alias("sum"),
            F.when((end >= window) & (total <= least), F.when(end - window <= state["end"], state["start"]).otherwise(end - window)
                   ).otherwise(state["start"]).alias("start"),
            F.when((end >= window) & (total <= least), end).otherwise(state["end"]).alias("end"),
            F.when((end >= window) & (total <= least) & (end - window > state["end"]) & (state["end"] > 0),
                   F.concat(state["out"], F.array(F.struct(state["start"].alias("start"), state["end"].alias("end"))))
                   ).otherwise(state["out"]).alias("out"))

    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("start"), F.lit(0).alias("end"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    return F.aggregate(
        _with(codes, lambda c: _with(weights, lambda w: changes(c, w))), start, step,
        lambda s: F.when(s["end"] > 0, F.concat(
            s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"]))


def _opened(spans: Column, first: int) -> Column:
    """(start, before, end) for every span that begins after all earlier ones have ended, or where the last one
    ends if ``first`` is 0: ``before`` is where those end, ``end`` where the span and all that overlap it end.
    ``spans`` are sorted by start."""
    def opened(s: Column) -> Column:
        ends = _before(F.transform(s, lambda x: x["end"]), first, lambda a, b: F.greatest(a, b))
        marked = F.zip_with(s, ends, lambda x, before: F.struct(x["start"].alias("start"), before.alias("before")))
        fresh = F.filter(marked, lambda x: (x["start"] >= x["before"]) if first == 0 else (x["start"] > x["before"]))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return _with(last, lambda end: _with(fresh, lambda xs: F.transform(xs, lambda x, i: F.struct(
            x["start"].alias("start"), F.greatest(x["before"], F.lit(0)).alias("before"),
            F.coalesce(F.get(xs, i + 1)["before"], end).alias("end")))))

    return _with(spans, opened)


def _united(spans: Column) -> Column:
    """Spans (start, end) by start, those that overlap or touch as one."""
    return F.transform(_opened(F.array_sort(spans), -1), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _candidate_spans(spans: Column, allowed: tuple[str, ...], classes: tuple[CharClass, ...]) -> Column:
    def readable(s: Column) -> Column:
        out = ~(s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
        for pattern in allowed:
            out = out | s["value"].rlike(pattern)
        return out

    def of_class(s: Column, c: CharClass) -> Column:
        runs = _spans(F.regexp_extract_all(s["value"], F.lit(c.pattern), F.lit(0)), F.split(s["value"], c.pattern, -1))
        runs = F.filter(runs, lambda r: (F.length(r["value"]) >= c.window) & ~readable(r))
        return F.flatten(F.transform(runs, lambda r: F.transform(
            entropy_spans(r["value"], c.window, c.bits), lambda w: F.struct(
                (s["start"] + r["start"] + w["start"]).alias("start"), (s["start"] + r["start"] + w["end"]).alias("end")))))

    return F.flatten(F.transform(
        F.filter(spans, lambda s: ~readable(s)), lambda s: _united(F.concat(*[of_class(s, c) for c in classes]))))


def scan(
    docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, classes: tuple[CharClass, ...] = CLASSES,
) -> DataFrame:
    """All columns of ``docs`` with ``secret_spans``: (start, rank, kind, end) by start, then kind.

    The base kinds are leftmost, non-overlapping matches, of which too short ones are dropped after they
    have matched. Kind ``entropy`` adds the high-entropy stretches of candidate strings that no allow-list
    pattern covers whole: each class's window slides over the maximal runs of its characters inside them, and
    a run is left out where it would be allowed as a candidate. Positions are code points, the end is exclusive. Texts are scanned where they
    are read, whole; only texts with a match pay for more than the search.

    Null and empty texts have no spans. Repeated rows are each scanned. A column of the added name is
    replaced. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c != "secret_spans"]
    rows = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("body"))
    # A run shorter than the limit holds no longer run, so the limits of these two can be in the pattern.
    patterns = {"assign": ASSIGN, "access": ACCESS[:-1] + "{16,}", "hex": HEX[:-1] + "{24,}", "entropy": CANDIDATE}
    parts = {}
    for kind, pattern in patterns.items():
        parts[f"{kind}_found"], parts[f"{kind}_gaps"] = _found(F.col("body"), pattern)
    rows = rows.withColumns(parts)
    rows = rows.select("row", *[
        F.when(F.col(f"{k}_found").isNotNull(), _spans(F.col(f"{k}_found"), F.col(f"{k}_gaps"))).alias(k) for k in KINDS])
    long_enough = F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    sources = {"assign": long_enough, "access": F.col("access"), "hex": F.col("hex"),
               "entropy": F.when(F.col("entropy").isNotNull(), _candidate_spans(F.col("entropy"), allowed, classes))}
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def listed_as(rank: int, kind: str) -> Column:
        return F.coalesce(F.transform(sources[kind], lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))), empty)

    listed = [listed_as(rank, kind) for rank, kind in enumerate(KINDS)]
    return rows.select(*[F.col(f"row.{c}").alias(c) for c in kept], F.sort_array(F.concat(*listed)).alias("secret_spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask``, overlapping spans by one; texts without a
    span, and null ones, stay as they are."""
    def masked(chunks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            at = F.floor(start / _CHUNK).cast("int")
            some = F.array_join(F.slice(chunks, at + 1, F.floor(end / _CHUNK).cast("int") - at + 1), "")
            return F.substring(some, start - at * _CHUNK + 1, end - start)

        parts = F.transform(_opened(F.col("secret_spans"), 0), lambda s: F.concat(piece(s["before"], s["start"]), F.lit(mask)))
        last = F.array_max(F.transform("secret_spans", lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), piece(last, F.length("text")))

    # Cut into chunks, a text is not walked from its start for every piece.
    chunks = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    text = F.when(F.size("secret_spans") > 0, _with(chunks, masked)).otherwise(F.col("text"))
    return scan(docs).withColumn("text", text).select(*docs.columns)
