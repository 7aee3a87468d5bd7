"""Substring dedup by recompression.

Rounds name runs of equal words, then pairs of neighbouring symbols, by rules that see nothing but the
symbols themselves: a name is a hash of what it stands for, so equal substrings get equal symbols in their
interior in every document, with no table of names to share. A symbol also knows the stretch of words its
forming depended on. A window holds the symbols whose stretch lies within it, and every copy of the window
holds the same ones; the longest is the window's anchor. Only windows whose anchor also occurs in another
text can repeat, and those are compared by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import materialised

ROUNDS = 6
_FAR = 1 << 40
_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93))
NO_ANCHOR = 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after the other, and where each text starts (one more for the end)."""
    split = [(t or "").encode().split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for ws in split for w in ws), dtype=np.uint64, count=int(starts[-1]))
    return hashes, starts


class Symbols:
    """Symbols of a batch of texts: name, words [start, end), and the words [low, high) they depend on.
    At a text's edge that stretch has no end, since the text might go on elsewhere."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS):
        n = len(hashes)
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        same = np.zeros(n + 1, dtype=bool)  # word i belongs to the text of the word before it
        same[1:n] = text[1:] == text[:-1]
        head = np.flatnonzero(~(same[:n] & np.concatenate([[False], hashes[1:] == hashes[:-1]]))) if n else np.empty(0, int)
        tail = np.append(head[1:], n)
        runs = tail - head
        self.name = np.where(runs > 1, _mix(hashes[head] * _ODD[0] + runs.astype(np.uint64) * _ODD[1]), hashes[head])
        self.start, self.end, self.text = head, tail, text[head]
        self.low = np.where(same[head], head - 1, -_FAR)
        self.high = np.where(same[tail], tail + 1, _FAR)
        for r in range(rounds):
            self._pairs(r)

    def _pairs(self, r: int) -> None:
        n = len(self.name)
        if n < 2:
            return
        left = ((self.name >> _U(r + 7)) & _U(1)).astype(bool)
        linked = self.text[1:] == self.text[:-1]
        pair = np.append(left[:-1] & ~left[1:] & linked, False)
        second = np.append(False, pair[:-1])
        # The neighbour that decided: the right one for left symbols, the left one for right symbols.
        next_low, next_high = np.append(np.where(linked, self.low[1:], -_FAR), -_FAR), np.append(np.where(linked, self.high[1:], _FAR), _FAR)
        last_low, last_high = np.append(-_FAR, np.where(linked, self.low[:-1], -_FAR)), np.append(_FAR, np.where(linked, self.high[:-1], _FAR))
        low = np.minimum(self.low, np.where(left, next_low, last_low))
        high = np.maximum(self.high, np.where(left, next_high, last_high))
        joined = _mix(self.name * _ODD[2] + np.append(self.name[1:], _U(0)) * _ODD[3] + _U(r + 1))
        name = np.where(pair, joined, self.name)
        end = np.where(pair, np.append(self.end[1:], 0), self.end)
        keep = ~second
        self.name, self.start, self.end = name[keep], self.start[keep], end[keep]
        self.low, self.high, self.text = low[keep], high[keep], self.text[keep]


def window_anchors(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, anchors): the first word of every window, and the name of the longest symbol within it, ties
    to the smaller name; NO_ANCHOR for windows without one."""
    counts = np.maximum(np.diff(starts) - window + 1, 0)
    total = int(counts.sum())
    at = np.repeat(starts[:-1] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(total)
    s = Symbols(hashes, starts)
    rank = ((_U(63) - np.minimum(s.end - s.start, 63).astype(np.uint64)) << _U(58)) | (s.name >> _U(6))
    best = np.full(total, np.iinfo(np.uint64).max, dtype=np.uint64)
    anchor = np.full(total, NO_ANCHOR, dtype=np.uint64)
    if not total or not len(s.name):
        return at, anchor
    inside = (s.high - s.low <= window)  # others fit no window
    low, high, rank, name = s.low[inside], s.high[inside], rank[inside], s.name[inside]
    first = np.searchsorted(s.start[inside], at)
    last = np.searchsorted(s.start[inside], at + window)
    live, k = np.arange(total), 0
    while len(live):
        j = first[live] + k
        more = j < last[live]
        live, j = live[more], j[more]
        better = (low[j] >= at[live]) & (high[j] <= at[live] + window) & (rank[j] < best[live])
        best[live[better]], anchor[live[better]] = rank[j[better]], name[j[better]]
        k += 1
    return at, anchor


def window_hashes(hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words of each window, as two polynomial sums of the word hashes."""
    out = []
    for values, odd in ((hashes, _ODD[0]), (_mix(hashes ^ _ODD[2]), _ODD[1])):
        power = np.cumprod(np.full(len(values) + 1, odd, dtype=np.uint64))
        inverse = np.cumprod(np.full(len(values) + 1, _U(pow(int(odd), -1, 1 << 64)), dtype=np.uint64))
        sums = np.append(_U(0), np.cumsum(values * inverse[:-1], dtype=np.uint64))
        out.append(_mix((sums[at + window] - sums[at]) * power[at]))
    return out[0], out[1]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _slices(batch: pa.RecordBatch, column: str, chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold about ``chars`` characters."""
    lengths = np.asarray([len(t.as_py() or "") for t in batch.column(column)])
    start, size = 0, 0
    for i, n in enumerate(lengths):
        size += n
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def _parsed(keyed: DataFrame, window: int) -> DataFrame:
    """Per document: its keys, n_words, the digest of all its words, and the distinct anchors of its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _slices(batch, "body"):
                part = batch.slice(i, j - i)
                texts = part.column("body").to_pylist()
                hashes, starts = word_hashes(texts)
                at, anchor = window_anchors(hashes, starts, window)
                owner = np.searchsorted(starts, at, side="right") - 1
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                anchors = [np.unique(anchor[a:b]).view(np.int64) for a, b in zip(bounds, bounds[1:], strict=False)]
                sizes = np.append(0, np.cumsum([len(a) for a in anchors])).astype(np.int32)
                flat = np.concatenate(anchors) if anchors else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("t1"), part.column("t2"), pa.array(np.diff(starts)),
                    pa.array([_sha(t.encode().split()) for t in texts]),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)),
                ], names=["doc_id", "t1", "t2", "n_words", "all_sha256", "anchors"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(
        run, f"doc_id {kind}, t1 long, t2 long, n_words long, all_sha256 string, anchors array<long>")


def _windows(candidates: DataFrame, window: int) -> DataFrame:
    """The distinct windows of candidate texts whose anchor other texts have as well, or that have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _slices(batch, "body"):
                part = batch.slice(i, j - i)
                hashes, starts = word_hashes(part.column("body").to_pylist())
                at, anchor = window_anchors(hashes, starts, window)
                owner = np.searchsorted(starts, at, side="right") - 1
                shared = part.column("shared")
                flat = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                ends = np.append(0, np.cumsum([len(x) for x in shared]))
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                keep = anchor == NO_ANCHOR
                for d, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    keep[a:b] |= np.isin(anchor[a:b], flat[ends[d] : ends[d + 1]])
                at, owner = at[keep], owner[keep]
                h1, h2 = window_hashes(hashes, at, window)
                once = np.unique(h1 ^ _mix(owner.astype(np.uint64)), return_index=True)[1]
                h1, h2, rows = h1[once], h2[once], pa.array(owner[once])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(rows), part.column("t1").take(rows), pa.array(h1.view(np.int64)),
                    pa.array(h2.view(np.int64)),
                ], names=["doc_id", "t1", "h1", "h2"])

    kind = candidates.schema["doc_id"].dataType.simpleString()
    return candidates.select("doc_id", "t1", "body", "shared").mapInArrow(
        run, f"doc_id {kind}, t1 long, h1 long, h2 long")


def _cut(found: DataFrame, window: int) -> DataFrame:
    """Per text with repeated windows: the words that stay, joined by one space, and how many go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, gone_windows in zip(batch.column("body"), batch.column("gone_windows"), strict=True):
                words = text.as_py().encode().split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                hashes, _ = word_hashes([text.as_py()])
                at = np.arange(len(words) - window + 1)
                found = gone_windows.values.to_numpy(zero_copy_only=False).view(np.uint64)
                starts = at[np.isin(window_hashes(hashes, at, window)[0], found)]
                np.add.at(gone, starts, 1)
                np.subtract.at(gone, starts + window, 1)
                stays = np.cumsum(gone)[:-1] == 0
                kept.append(b" ".join([w for w, s in zip(words, stays, strict=True) if s]).decode())
                removed.append(len(words) - int(stays.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(kept, pa.string()),
                 pa.array(removed, pa.int64())], names=["doc_id", "t1", "t2", "kept_text", "removed"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "t1", "t2", "body", "gone_windows").mapInArrow(
        run, f"doc_id {kind}, t1 long, t2 long, kept_text string, removed long")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, all_sha256, kept_text) of every document.

    Every word in a window that a document with a smaller doc_id has too is removed; windows are judged on
    the input. ``kept_text`` is null where nothing goes, in which case ``all_sha256`` is the digest of the
    words, and else the words that stay.

    Equal texts are one text to the search, with the smallest of their ids: the others lose all their windows
    to it. Of the rest, anchors are counted per text, after each task has reduced its own, so a passage in a
    third of all documents is one row per task; windows that may repeat are compared by 128 bits of their
    words, reduced the same way. Null text has no words. A null doc_id is larger than every other. Texts
    shorter than the window stay whole, repeated rows get the same answer, an empty table gives none.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", body.alias("body"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2"))
    parsed = materialised(_parsed(keyed, window), "repeats-parsed")
    firsts = parsed.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"))

    anchors = parsed.select("t1", F.explode("anchors").alias("anchor"))
    shared = anchors.where(F.col("anchor") != NO_ANCHOR).groupBy("anchor").agg(
        F.min("t1").alias("least"), F.max("t1").alias("most")).where("least <> most").select("anchor")
    per_text = anchors.join(shared, "anchor", "left_semi").union(
        anchors.where(F.col("anchor") == NO_ANCHOR).select("anchor", "t1")
    ).groupBy(F.col("t1").alias("of_t1")).agg(F.collect_set("anchor").alias("shared"))
    wanted = materialised(
        firsts.join(per_text, F.col("t1") == F.col("of_t1")).select(
            F.col("t1").alias("of_t1"), F.col("t2").alias("of_t2"), "first_id", "shared"), "repeats-wanted")
    candidates = materialised(
        keyed.join(wanted, (F.col("t1") == F.col("of_t1")) & (F.col("t2") == F.col("of_t2"))
                   & F.col("doc_id").eqNullSafe(F.col("first_id"))
                   ).select("doc_id", "t1", "t2", "body", "shared"), "repeats-candidates")

    windows = _windows(candidates, window)  # made twice: cheaper than to keep, being most of the bytes here
    # A null id is larger than every other: it never is the smallest, and loses to any.
    repeated = windows.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.bool_or(F.col("doc_id").isNull()).alias("open")
    ).where("least < most or (least is not null and open)").select("h1", "h2", "least")
    hits = windows.join(repeated, ["h1", "h2"]).where("doc_id is null or least < doc_id").select("doc_id", "t1", "h1")
    gone = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("t1").alias("hit_t1")).agg(
        F.collect_set("h1").alias("gone_windows"))
    cut = _cut(candidates.dropDuplicates(["t1", "t2"]).join(
        gone, (F.col("t1") == F.col("hit_t1")) & F.col("doc_id").eqNullSafe(F.col("hit_id"))), window)
    named = materialised(
        firsts.join(cut.select(F.col("t1").alias("cut_t1"), F.col("t2").alias("cut_t2"), "kept_text", "removed"),
                    (F.col("t1") == F.col("cut_t1")) & (F.col("t2") == F.col("cut_t2")), "left")
        .select(F.col("t1").alias("of_t1"), F.col("t2").alias("of_t2"), "first_id", "kept_text", "removed"),
        "repeats-cut")
    rows = parsed.select("doc_id", "t1", "t2", "n_words", "all_sha256").join(
        named, (F.col("t1") == F.col("of_t1")) & (F.col("t2") == F.col("of_t2")))
    copy = (F.col("n_words") >= window) & ~F.col("doc_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    return rows.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        "all_sha256", F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


def digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of ``remove_repeats``."""
    return remove_repeats(docs, window).select(
        "doc_id", "n_words", "n_removed",
        F.coalesce(F.sha2(F.col("kept_text").cast("binary"), 256), F.col("all_sha256")).alias("kept_sha256"))
