"""Mixing sources to target weights along a time-varying curriculum.

Every source has a share of the words to train on and a schedule that says how its rate changes between
the start (0) and the end (1) of training. The schedule's integral is the source's cumulative demand;
inverting it gives each document the time at which its words are due. Documents are then sorted by time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import materialised, with_running, words

#: Relative rate at points of training time, one schedule per weight class: the heaviest sources fade in,
#: the middle ones stay level and the lightest fade out.
SCHEDULES = (
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
)

Schedule = Sequence[tuple[float, float]]


def due_time(share: Column, schedule: Schedule) -> Column:
    """Time at which a source has delivered ``share`` (0 to 1) of its demand: the inverse of the schedule's
    integral. Rates are linear between points, so each piece inverts by a square root."""
    pieces, area = [], 0.0
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:], strict=False):
        pieces.append((t0, r0, (r1 - r0) / (t1 - t0), area))
        area += (t1 - t0) * (r0 + r1) / 2
    need, time = share * area, None
    for t0, rate, slope, start in pieces:
        y = F.greatest(need - start, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(rate * rate) + 2 * slope * y, F.lit(0.0)))
        at = t0 + F.when(y > 0, 2 * y / (rate + root)).otherwise(0.0)
        time = at if time is None else F.when(need >= start, at).otherwise(time)
    return F.least(time, F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, class, target): words to take from each source.

    Sources in code point order, null last, get the weights in turn. ``share`` times all words are
    divided by weight; a target stops at ``cap`` times its source's size and the excess is divided among
    the others, until none is above. Each round needs three sums of the table of sources.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = with_running(
        per_source.withColumn("one", F.lit(1).cast("long")), [], [F.col("source").asc_nulls_last()],
        "one", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("before") % len(weights) + 1).cast("int"))
    table = materialised(
        numbered.select("source", "source_size", F.col("before").alias("place"), weight.alias("weight")),
        "mix-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * cap <= F.col("weight") * level
        n, taken, open_weight = table.agg(
            F.count_if(full), F.sum(F.when(full, F.col("source_size") * cap).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, max(0.0, (share * total - taken) / open_weight)
    whole = F.lit(not open_weight)
    target = F.when(whole, F.col("source_size") * cap).otherwise(
        F.least(F.col("source_size") * cap, F.col("weight") * level))
    return table.select("source", "source_size", "place", target.alias("target"))


def assign(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    schedules: Sequence[Schedule] = SCHEDULES, seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, placements.

    A source's documents stand in a fixed pseudo-random order and are read round and round until the
    target (to the nearest word) is reached: all documents get the same number of full passes, those at
    the front one more, and at most one per source is cut, after its first words. ``placements`` holds
    (copy, words, position), position being the training time from 0 to 1.

    Null text has size 0; documents without words are never placed. A null source is a source of its own
    and comes last. Documents with equal ids are told apart by their text. An empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id").alias("draw"), F.xxhash64(text).alias("tie"))
    order = [F.col("draw"), F.col("doc_id"), F.col("tie")]
    run = materialised(with_running(sizes, ["source"], order, "size", "mix-order"), "mix-run")
    goal = targets(run, weights, share, cap)
    joined = run.join(goal, run["source"].eqNullSafe(goal["source"])).drop(goal["source"])

    want = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long")
    rest = want - passes * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    placed = joined.withColumns({"want": want, "passes": passes, "last": last})
    kind = F.col("place") % len(schedules)

    def position(copy: Column) -> Column:
        share_of = (copy * F.col("source_size") + F.col("before")) / F.col("want")
        at = due_time(share_of, schedules[-1])
        for k, schedule in enumerate(schedules[:-1]):
            at = F.when(kind == k, due_time(share_of, schedule)).otherwise(at)
        return at

    def placement(copy: Column) -> Column:
        full = copy < F.col("passes")
        return F.struct(
            copy.alias("copy"), F.when(full, F.col("size")).otherwise(F.col("last")).alias("words"),
            position(copy).alias("position"))

    all_copies = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), placement)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("last")).alias("taken"),
        F.filter(all_copies, lambda p: p["words"] > 0).alias("placements"), "tie", "draw")


def in_training_order(frame: DataFrame, position: Column) -> DataFrame:
    """Range-sorted by position; rows without one follow, spread by their draw."""
    spread = 1 + (F.col("draw") / 2.0**64 + 0.5)
    return (frame.withColumn("sort_key", F.coalesce(position, spread))
            .repartitionByRange("sort_key").sortWithinPartitions("sort_key", "doc_id").drop("sort_key"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents to train on, in training order: all columns of ``docs``, one row per copy, with
    ``mix_copy`` and ``mix_position`` added (columns of these names in ``docs`` are replaced). A copy
    that the target cuts keeps its first words, joined by one space. Repeated rows all follow the first one's plan."""
    plan = assign(docs, **options).where(F.size("placements") > 0).groupBy("doc_id", "tie", "size", "draw")
    plan = plan.agg(F.min("placements").alias("placements")).select(
        F.col("doc_id").alias("mix_id"), F.col("tie").alias("mix_tie"), "size", "draw",
        F.explode("placements").alias("placement"))
    kept = [c for c in docs.columns if c not in ("mix_copy", "mix_position")]
    rows = docs.select(
        F.struct(*kept).alias("row"), F.col("doc_id").alias("row_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_tie"))
    joined = rows.join(
        plan, rows["row_id"].eqNullSafe(plan["mix_id"]) & (rows["row_tie"] == plan["mix_tie"]))
    text = F.when(F.col("placement.words") >= F.col("size"), F.col("row.text")).otherwise(
        F.array_join(F.slice(words(F.col("row.text")), F.lit(1), F.col("placement.words").cast("int")), " "))
    out = joined.select("row", text.alias("cut"), "placement", "draw", F.col("row_id").alias("doc_id"))
    return in_training_order(out, F.col("placement.position")).select(
        *[F.col("cut" if c == "text" else f"row.{c}").alias(c) for c in kept],
        F.col("placement.copy").alias("mix_copy"), F.col("placement.position").alias("mix_position"))
