"""Repair of conversation structure at least cost, by Hirschberg's divide and conquer.

A conversation is read by an automaton of four states: nothing yet, after a system turn, after a user turn, after an
assistant turn. Vectors of the cost to reach each state from the front and to finish from each state at the back
meet in the middle; the crossing on the least audit is fixed and both halves are solved the same way, so a solution
takes no more memory than the rows themselves. Long conversations are cut into blocks: each block's costs between
states are a small matrix, the same method over these finds the states at the cuts, and blocks are solved apart.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import SEPARATORS, materialised, with_running

_BLOCK = 8192
_EMPTY_HASH = hashlib.sha256(b"").hexdigest()

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_INSERT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}  # what may follow, but for a first system turn
_KEEP = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}, "": {}}
_INITIALS = ("s", "u", "a", "")
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
_REROLE, _DELETE, _ADD, _CUT = 2, 3, 2, 1
_TAIL = ((0, ""), (2 * _ADD, "II"), (_ADD, "I"), (0, ""))  # cost and edits to end from each state

#: A step leads from a state to (state, cost, order): ``order`` ranks ways of equal cost, which never end alike.
Step = Sequence[Sequence[tuple[int, int, object]]]


@cache
def row_step(code: int) -> Step:
    """The step of one row: insertions before it and what is done with it, as the letters of the audit. ``code``:
    the place of the role's initial, plus 4 if the row must go, plus 8 if it is cut off."""
    initial, must_go, cut = _INITIALS[code & 3], code >> 2 & 1, code >> 3
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        at, cost, letters = state, 0, ""
        for _ in range(3):  # a third insertion leads to no new state
            ways = [(at, _DELETE, "D")]
            if not must_go:
                ways.append((_INSERT[at], _REROLE + _CUT * cut, "R"))
                if at in _KEEP[initial]:
                    ways.append((_KEEP[initial][at], _CUT * cut, "K"))
            for to, more, letter in ways:
                way = (cost + more, letters + letter)
                best[to] = min(best.get(to, way), way)
            at, cost, letters = _INSERT[at], cost + _ADD, letters + "I"
        out.append(tuple((to, c, x) for to, (c, x) in best.items()))
    return tuple(out)


def forward(steps: Sequence[Step], lo: int, hi: int, state: int) -> list[tuple[float, int]]:
    """(cost, rank) of each state after the steps: ranks order the least audits that lead to the states. Audits of
    as many rows are never beginnings of each other, so what follows can't change their order."""
    now: list[tuple[float, int]] = [(math.inf, 4)] * 4
    now[state] = (0, 0)
    for step in steps[lo:hi]:
        best: dict[int, tuple] = {}
        for p, (cost, rank) in enumerate(now):
            if cost < math.inf:
                for q, more, order in step[p]:
                    way = (cost + more, rank, order)
                    if q not in best or way < best[q]:
                        best[q] = way
        ranked = sorted(best, key=lambda q: best[q][1:])
        now = [(math.inf, 4)] * 4
        for rank, q in enumerate(ranked):
            now[q] = (best[q][0], rank)
    return now


def backward(steps: Sequence[Step], lo: int, hi: int, end: Sequence[float]) -> list[float]:
    """The cost to finish from each state before the steps."""
    now = list(end)
    for step in reversed(steps[lo:hi]):
        now = [min((more + now[q] for q, more, _ in step[p]), default=math.inf) for p in range(4)]
    return now


def solve(steps: Sequence[Step], state: int, end: Sequence[float]) -> list[tuple[int, object]]:
    """(state after it, order) of every step on the cheapest way, of the cheapest ones that with the least audit."""
    out: list[tuple[int, object]] = []

    def between(lo: int, hi: int, state: int, end: Sequence[float]) -> int:
        if hi - lo == 1:
            _, order, to = min((cost + end[q], order, q) for q, cost, order in steps[lo][state])
            out.append((to, order))
            return to
        mid = (lo + hi) // 2
        front, back = forward(steps, lo, mid, state), backward(steps, mid, hi, end)
        crossing = min(range(4), key=lambda q: (front[q][0] + back[q], front[q][1]))
        between(lo, mid, state, [0 if q == crossing else math.inf for q in range(4)])
        return between(mid, hi, crossing, end)

    if steps:
        between(0, len(steps), state, end)
    return out


def matrix(codes: Sequence[int]) -> list[int]:
    """Cost and rank from each state to each state over a block, 32 numbers; -1 where there is no way."""
    steps, out = [row_step(c) for c in codes], []
    for state in range(4):
        for cost, rank in forward(steps, 0, len(steps), state):
            out += [-1, -1] if cost == math.inf else [int(cost), rank]
    return out


def matrix_step(numbers: Sequence[int]) -> Step:
    return [[(q, numbers[8 * p + 2 * q], numbers[8 * p + 2 * q + 1]) for q in range(4) if numbers[8 * p + 2 * q] >= 0]
            for p in range(4)]


def block_edits(codes: Sequence[int], entry: int, leave: int | None, last: bool) -> tuple[str, int, list[tuple]]:
    """(audit, cost, [(place, part, letter, role)]) of a block entered in state ``entry`` and left in ``leave``."""
    end = [c if leave is None or q == leave else math.inf for q, (c, _) in enumerate(_TAIL)]
    audit, cost, edits, state = [], 0, [], entry
    ways = solve([row_step(c) for c in codes], entry, end)
    for place, (code, (to, letters)) in enumerate(zip(codes, ways, strict=True)):
        cost += next(c for q, c, _ in row_step(code)[state] if q == to)
        for part, letter in enumerate(letters):
            role = None
            if letter in "IR":
                state = _INSERT[state]
                role = _ROLES[state]
            elif letter == "K":
                state = to
            edits.append((place, part, letter, role))
        audit.append(letters)
    if last:
        more, letters = _TAIL[state]
        cost += more
        for part, letter in enumerate(letters):
            state = _INSERT[state]
            edits.append((len(codes) - 1, 9 + part, letter, _ROLES[state]))
        audit.append(letters)
    return "".join(audit), cost, edits


def illegal_pairs(codes: Sequence[int]) -> int:
    initials = [_INITIALS[c & 3] for c in codes]
    return sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:], strict=False))


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of what is left of ``rows`` (conv_id, turn, role, text): a fifth of the residues of
    crc32(``conv_id:turn``) by 20 each drop, empty, cut, repeat or rerole a row. Nulls count as one space, but
    a null turn stays null in the result. ``conv`` is a struct of the id, which compares equal where ids are null."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    role, text = shown("role"), shown("text")
    out = rows.select(
        F.struct("conv_id").alias("conv"), "turn", hit.alias("hit"),
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("hit") == 3, 1).otherwise(0)))
    return out.where("hit <> 0").select("conv", "turn", "role", "text", copies.alias("copy")).drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) with ``at``, the place in the conversation by turn, nulls first; rows of one
    turn by role and text. A conversation of any length is spread over tasks."""
    hashed = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text"), "one": F.lit(1).cast("long")})
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h1").asc(), F.col("h2").asc()]
    return materialised(with_running(hashed, ["conv"], order, "one", "turns-ranged").withColumnRenamed("before", "at").drop("one"),
                        "turns")


def coded(turns: DataFrame) -> DataFrame:
    """(conv, turn, at, code, fault): the first fault of every row (blank, duplicate, truncated or null), and its
    code for ``row_step``. Copies are known by the least place of each (role, text), summed up before any exchange."""
    first = turns.groupBy("conv", "role", "h1", "h2").agg(F.min("at").alias("first_at")).select(
        F.col("conv").alias("of_conv"), "first_at")
    bare = F.rtrim(F.translate("text", SEPARATORS[1:], " " * len(SEPARATORS[1:])))
    rows = turns.select("conv", "turn", "at", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
                        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    rows = rows.join(first, (F.col("conv") == F.col("of_conv")) & (F.col("at") == F.col("first_at")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first_at").isNull(), "duplicate").when(F.col("cut"), "truncated")
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in _INITIALS[:3]]), F.col("initial")), F.lit(0)).cast("int")
    place = F.when(place > 0, place - 1).otherwise(3)
    code = place + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)
    return rows.select("conv", "turn", "at", "blank", "cut", "first_at", "initial", fault.alias("fault")).select(
        "conv", "turn", "at", code.alias("code"), "fault")


def _each(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function(row)`` gives the values of ``schema`` for every row; the first column, ``conv``, is passed on."""
    conv = rows.schema["conv"].dataType.simpleString()
    names = [f.split(" ")[0] for f in schema.split("; ")]
    full = f"conv {conv}, " + schema.replace("; ", ", ")
    types = rows.sparkSession.createDataFrame([], full).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [function(r) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([f[k] for f in found], arrow.field(k + 1).type) for k in range(len(names))]],
                    names=["conv", *names])

    return rows.mapInArrow(run, full)


def edits(codes: DataFrame, block_rows: int = _BLOCK) -> DataFrame:
    """(conv, block, audit, cost, illegal, edits) from ``codes`` (conv, at, code). ``edits``: (at, part, letter, role)
    in order, the role of an inserted or reroled row. ``block_rows`` changes no result."""
    blocks = codes.groupBy("conv", F.floor(F.col("at") / block_rows).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "code"))).alias("held")).select(
        "conv", "block", F.transform("held", lambda x: x["code"]).alias("codes"))
    blocks = materialised(blocks, "turn-blocks")
    many = blocks.where("block > 0").select(F.col("conv").alias("of_conv")).distinct()
    long = blocks.join(many, F.col("conv") == F.col("of_conv"), "left_semi")
    matrices = _each(long, lambda r: (r["block"], matrix(r["codes"])), "block long; costs array<long>")

    def crossings(row: dict) -> tuple:
        steps = [matrix_step(x["costs"]) for x in row["held"]]
        states = [q for q, _ in solve(steps, _START, [c for c, _ in _TAIL])]
        return ([{"of_block": x["block"], "entry": p, "leave": q, "last": k == len(states) - 1}
                 for k, (x, p, q) in enumerate(zip(row["held"], [_START, *states], states, strict=False))],)

    per_conv = matrices.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "costs"))).alias("held"))
    states = _each(per_conv, crossings, "cuts array<struct<of_block:bigint,entry:int,leave:int,last:boolean>>").select(
        F.col("conv").alias("of_conv"), F.explode("cuts").alias("cut")).select("of_conv", "cut.*")
    # The last role's initial before a block, for the pair that a cut parts.
    before = F.lag(F.element_at("codes", -1)).over(Window.partitionBy("conv").orderBy("block"))
    ready = blocks.withColumn("before", before).join(
        states, (F.col("conv") == F.col("of_conv")) & (F.col("block") == F.col("of_block")), "left").select(
        "conv", "block", "codes", "before", "entry", "leave", "last")

    def solved(r: dict) -> tuple:
        single = r["entry"] is None
        audit, cost, found = block_edits(
            r["codes"], _START if single else r["entry"], None if single else r["leave"], single or r["last"])
        joined = r["codes"] if r["before"] is None else [r["before"], *r["codes"]]
        first = r["block"] * block_rows
        return r["block"], audit, cost, illegal_pairs(joined), [
            {"at": first + place, "part": part, "letter": letter, "role": role} for place, part, letter, role in found]

    return _each(ready, solved, "block long; audit string; cost long; illegal long; "
                                "edits array<struct<at:bigint,part:int,letter:string,role:string>>")


def repaired_rows(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv, at, part, edit, role, text) of every row that is kept or inserted, whose order is (at, part)."""
    made = solved.select(F.col("conv").alias("of_conv"), F.explode("edits").alias("e")).select(
        "of_conv", F.col("e.at").alias("of_at"), F.col("e.part").alias("part"), F.col("e.letter").alias("edit"),
        F.col("e.role").alias("new_role")).where("edit <> 'D'")
    held = turns.select("conv", "at", F.col("role").alias("old_role"), F.col("text").alias("old_text"))
    joined = made.join(held, (F.col("conv") == F.col("of_conv")) & (F.col("at") == F.col("of_at")))
    return joined.select(
        "conv", "at", "part", "edit", F.coalesce("new_role", "old_role").alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("old_text")).alias("text"))


def hashes(rows: DataFrame) -> DataFrame:
    """(of_conv, repaired_sha256) over ``role:text`` of each conversation's rows, joined by line breaks. Rows stream
    through a task in order, so a conversation of any length takes no memory."""
    conv = rows.schema["conv"].dataType.simpleString()
    shown = F.concat("role", F.lit(":"), "text")
    dealt = rows.select("conv", "at", "part", shown.alias("shown")).repartition("conv").sortWithinPartitions("conv", "at", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, digest, kind = None, None, None
        for batch in batches:
            kind, done = batch.column(0).type, []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is not None and key == open_conv:
                    digest.update(b"\n" + text.encode())
                else:
                    if digest is not None:
                        done.append((open_conv, digest.hexdigest()))
                    open_conv, digest = key, hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done])], names=names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_conv], kind), pa.array([digest.hexdigest()])], names=names)

    names = ["of_conv", "repaired_sha256"]
    return dealt.select("conv", "shown").mapInArrow(run, f"of_conv {conv}, repaired_sha256 string")


def repair(rows: DataFrame, block_rows: int = _BLOCK) -> DataFrame:
    """(conv_id, position, edit, role, text) of the repaired conversations of ``rows`` (conv_id, turn, role, text):
    the cheapest edits make role initials match ``(s?(ua)+)?`` and leave no blank row and no copy. Nulls in role and
    text count as one space. ``position`` is gapless from 0; a conversation that loses all rows is not in the result."""
    shown = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    turns = numbered(rows.select(F.struct("conv_id").alias("conv"), "turn", *shown))
    out = repaired_rows(turns, edits(coded(turns).select("conv", "at", "code"), block_rows)).withColumn("one", F.lit(1).cast("long"))
    placed = with_running(out, ["conv"], [F.col("at").asc(), F.col("part").asc()], "one", "turns-repaired")
    return placed.select("conv.conv_id", F.col("before").alias("position"), "edit", "role", "text")


def digest(rows: DataFrame, damaged: bool = True, block_rows: int = _BLOCK) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text), after ``damage`` if asked: what was found, the edits
    and a hash of what they make.

    conv_id, gaps (turn numbers missing between the least and the greatest, nulls ignored), blank, duplicate, truncated
    (first faults), illegal (neighbours whose role initials are not su, ua or au), cost, audit (initials of Keep,
    Rerole, Delete and Insert; of the cheapest edits the ASCII-least), repaired_sha256.

    A null conv_id is a conversation like others. Rows of one turn are taken by role and text. Conversations without
    rows have zeros, an empty audit and the hash of nothing. Rows reduce to small codes before they are gathered, in
    blocks of at most ``block_rows``; only the audit and the hash are as long as a conversation. Other columns
    are not read. An empty table gives no rows.
    """
    asked = rows.select("conv_id", "turn", "role", "text")
    shown = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    turns = numbered(damage(asked) if damaged else asked.select(F.struct("conv_id").alias("conv"), "turn", *shown))
    codes = materialised(coded(turns), "turn-codes")
    solved = materialised(edits(codes.select("conv", "at", "code"), block_rows), "turn-edits")
    faults = codes.groupBy("conv").agg(*[
        F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    turn_counts = codes.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("seen")).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    audits = solved.groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    out = asked.select(F.struct("conv_id").alias("conv")).distinct()
    hashed = hashes(repaired_rows(turns, solved)).withColumnRenamed("of_conv", "conv")
    for part in (faults, turn_counts, audits, hashed):
        out = out.join(part, "conv", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(_EMPTY_HASH)).alias("repaired_sha256"))
