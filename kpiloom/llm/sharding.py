"""Sharding by histogram sort: exact byte counts below candidate boundaries fix the splitters, then the rows
are exchanged once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import materialised

_BITS = 8
_ROUNDS = 128 // _BITS
_LEAST = -(2**63)


def _prefix(round_no: int) -> tuple[Column, Column]:
    """The leading bits of the 128-bit key that round ``round_no`` compares, as two longs."""
    used = _BITS * (round_no + 1)
    if used <= 64:
        return F.shiftright("k1", 64 - used), F.lit(0).cast("long")
    return F.col("k1"), F.shiftright("k2", 128 - used)


def _start(prefix: tuple[int, int], round_no: int) -> tuple[int, int]:
    used = _BITS * (round_no + 1)
    if used <= 64:
        return prefix[0] << (64 - used), _LEAST
    return prefix[0], prefix[1] << (128 - used)


def _next(prefix: tuple[int, int], round_no: int) -> tuple[int, int]:
    """The first key after all keys with this prefix (beyond 64 bits for the last one: above every key)."""
    if _BITS * (round_no + 1) <= 64:
        return _start((prefix[0] + 1, 0), round_no)
    start = _start((prefix[0], prefix[1] + 1), round_no)
    return start if start[1] < 2**63 else (prefix[0] + 1, _LEAST)


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[tuple[int, int], int]]:
    """``parts - 1`` (key, rows below it), ascending, that cut the rows' bytes evenly.

    Each round divides the open interval of every unsettled splitter into 256 and counts exact bytes and
    rows in each; the driver gets at most 256 sums per splitter and keeps the interval that holds the
    wanted byte. A splitter settles when a boundary is within ``tolerance`` of a part's bytes of it, or the
    interval holds a single row.
    """
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    allowed = tolerance * total / parts
    found: dict[int, tuple[tuple[int, int], int]] = {}
    open_at = {i: ((0, 0), 0, 0) for i in range(1, parts)}  # parent, bytes and rows before it
    for round_no in range(_ROUNDS):
        if not open_at or not rows:
            break
        p1, p2 = _prefix(round_no)
        level = keys.select(p1.alias("p1"), p2.alias("p2"), "size", "k1", "k2")
        if round_no:
            parents = sorted({p for p, _, _ in open_at.values()})
            q1, q2 = _prefix(round_no - 1)
            level = level.where(
                q1.isin([a for a, _ in parents]) if _BITS * round_no <= 64
                else q1.isin(sorted({a for a, _ in parents})) & q2.isin(sorted({b for _, b in parents})))
        else:
            parents = [(0, 0)]
        sums = level.groupBy("p1", "p2").agg(F.sum("size"), F.count("*")).collect()
        children: dict[tuple[int, int], list] = {p: [] for p in parents}
        for a, b, size, n in sums:
            used = _BITS * (round_no + 1)
            up = (0, 0) if not round_no else (a >> _BITS, 0) if used <= 64 else (
                (a, 0) if used == 64 + _BITS else (a, b >> _BITS))
            if up in children:
                children[up].append(((a, b), size, n))
        still = {}
        for i, (parent, size_before, rows_before) in open_at.items():
            goal, at, n_at = total * i / parts, size_before, rows_before
            kids = sorted(children[parent])
            for k, (child, size, n) in enumerate(kids):
                if at + size > goal or k == len(kids) - 1:
                    break
                at, n_at = at + size, n_at + n
            left, right = goal - at, at + size - goal
            if min(abs(left), abs(right)) <= allowed or n == 1 or round_no == _ROUNDS - 1:
                found[i] = ((_start(child, round_no), n_at) if left <= right
                            else (_next(child, round_no), n_at + n))
            else:
                still[i] = (child, at, n_at)
        open_at = still
    return [found.get(i, ((2**63, _LEAST), rows)) for i in range(1, parts)]


def _place(cuts: list[tuple[int, int]], low: int, high: int) -> Column:
    """Number of cuts at or below the row's key, by binary search as nested conditions."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    a, b = cuts[mid]
    if a >= 2**63:
        return _place(cuts, low, mid)
    below = (F.col("k1") < a) | ((F.col("k1") == a) & (F.col("k2") < b)) if b > _LEAST else F.col("k1") < a
    return F.when(below, _place(cuts, low, mid)).otherwise(_place(cuts, mid + 1, high))


def shard(
    docs: DataFrame, n_shards: int = 40, overhead: int = 16, tolerance: float = 0.005,
    part_bytes: int = 32 << 20,
) -> DataFrame:
    """All columns of ``docs`` with ``shard_bytes``, ``shard`` (0 to ``n_shards`` - 1) and ``shard_slot``.

    Law: shards hold nearly equal bytes (UTF-8 text plus ``overhead`` per row). The sort key is a hash of
    the text, then one of doc_id: copies of a text stay together unless they fill more than the tolerance
    across a boundary, so a text with a third of all rows is divided like the rest. Shards larger than
    ``part_bytes`` are written by several tasks; slots stay gapless, as the histogram has counted the rows
    below every splitter.

    Null text counts no bytes and is keyed as the empty text. Repeated rows share a key and stay together.
    Columns named like the added ones are replaced. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("shard_bytes", "shard", "shard_slot")]
    keyed = docs.select(
        F.struct(*kept).alias("row"), F.xxhash64(text).alias("k1"), F.xxhash64("doc_id").alias("k2"),
        (F.octet_length(text) + overhead).cast("long").alias("size"))
    keys = materialised(keyed.select("k1", "k2", "size"), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per = max(1, math.ceil(total / n_shards / part_bytes))
    cuts = splitters(keys, n_shards * per, tolerance)
    placed = keyed.withColumn("part", _place([c for c, _ in cuts], 0, len(cuts)))
    below = [0] + [n for _, n in cuts]
    start = F.element_at(
        F.array(*[F.lit(below[p] - below[p - p % per]).cast("long") for p in range(n_shards * per)]),
        F.col("part") + 1)
    inside = Window.partitionBy("part").orderBy("k1", "k2", F.col("row.doc_id"))
    return placed.withColumn("at", F.row_number().over(inside)).select(
        *[F.col(f"row.{c}").alias(c) for c in kept], F.col("size").alias("shard_bytes"),
        F.floor(F.col("part") / per).cast("int").alias("shard"),
        (start + F.col("at") - 1).alias("shard_slot"))
