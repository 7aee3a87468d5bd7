"""Hierarchical multi-length packing of tokenized documents.

Documents are routed to context-size tiers. Each tier is packed by best fit, long windows first, with gaps
filled from shorter tiers; the last gap of a window is filled by cutting a piece off a document, so windows
end full. Windows of a tier are numbered into step groups of equal tokens.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import materialised

_END = 1  # id that closes a document
_BUFFER_TOKENS = 2_000_000
_SHARED_ROWS = 500_000


# Fixed value: how byte-level vocabularies split a text before merging.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space runs from here on are left to the tokenizer itself: the rank encoder's pattern matches by recursion.
_LONG_BLANK = re.compile(r"\s{2000}")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their names in a text are text
    return tokenizer


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write visible Latin-1 bytes as themselves, the others as letters from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if it is a plain byte-level one whose ids after the bytes follow the merges: then
    merging the pair of lowest rank is what the tokenizer does."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"]
    options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if (model["type"] != "BPE" or any(model.get(o) for o in options) or spec["normalizer"] or not before
            or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]):
        return None
    byte, vocab = _byte_of_letter(), model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if len(vocab) != 256 + len(pairs) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    return {bytes(byte[c] for c in token): i for token, i in vocab.items()}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, the same as the tokenizer of ``path`` gives.

    A byte-level vocabulary is run by its ranks, which takes about a third of the tokenizer's time and no
    memory of what was seen; other vocabularies, and texts with very long white space, by the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, ranks = path, _ranks(path)
        self.ranked = ranks and tiktoken.Encoding(
            "ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def one(self, text: str) -> bytes:
        if self.ranked and not (len(text) >= 2000 and _LONG_BLANK.search(text)):
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        return array("I", _tokenizer(self.path).encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


@cache
def _encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


class Pool:
    """Pieces of documents by length, with the lengths in use as the bits of one integer."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.mask = 0

    def add(self, piece: tuple) -> None:
        n = piece[2]
        self.by_length.setdefault(n, []).append(piece)
        self.mask |= 1 << n

    def longest(self, most: int) -> int:
        """The greatest length in use up to ``most``, or 0."""
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.mask & ((1 << (most + 1)) - 1) else 0

    def shortest_over(self, least: int) -> int:
        above = self.mask >> (least + 1)
        return least + (above & -above).bit_length() if above else 0

    def take(self, n: int) -> tuple:
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            self.mask &= ~(1 << n)
        return piece


def pack_pieces(pool: Pool, tiers: Sequence[int]) -> Iterator[tuple[int, list]]:
    """(tier, pieces) of full windows; what can't fill a window any more stays in the pool.

    A piece is (document, start, length). A window opens with the longest document of its tier. Its gap
    takes the longest piece that fits; when none does, a piece is cut from the shortest that is too long.
    """
    for tier, below in zip(sorted(tiers, reverse=True), [*sorted(tiers, reverse=True)[1:], 0], strict=True):
        while (n := pool.longest(tier)) > below:
            window, gap = [pool.take(n)], tier - n
            while gap:
                if n := pool.longest(gap):
                    window.append(pool.take(n))
                    gap -= n
                elif n := pool.shortest_over(gap):
                    doc, start, length = pool.take(n)
                    window.append((doc, start, gap))
                    pool.add((doc, start + gap, length - gap))
                    gap = 0
                else:
                    break
            if gap:
                for piece in window:
                    pool.add(piece)
                return
            yield tier, window


def last_windows(pool: Pool, tiers: Sequence[int]) -> Iterator[tuple[int, list]]:
    """The pool's rest in as few windows as fill whole tiers, longest first, and a short one as tier 0."""
    rest = []
    while n := pool.longest(max(tiers)):
        rest.append(pool.take(n))
    left = sum(p[2] for p in rest)
    for tier in sorted(tiers, reverse=True):
        while left >= tier:
            window, gap = [], tier
            while gap:
                doc, start, length = rest.pop()
                take = min(gap, length)
                window.append((doc, start, take))
                if take < length:
                    rest.append((doc, start + take, length - take))
                gap -= take
            left -= tier
            yield tier, window
    if rest:
        yield 0, rest


def pack(
    docs: DataFrame, tokenizer: str, tiers: Sequence[int] = (256, 512, 1024, 2048), step_tokens: int = 131_072,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, tier, step_group.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers; a document's ids end with
    id 1. Every full window holds exactly its tier's tokens, a power of two; each task closes with at most
    one window that is not full. Documents are packed in the task that reads and tokenizes them, with a
    buffer of two million ids, so nothing is shuffled and a document of any length is cut into windows
    as it comes. ``sequence_id`` is unique over all tasks and the same when a lost task is run again.

    ``step_group`` puts the windows of a tier into groups of ``step_tokens`` tokens, so every step of training
    has as many tokens, in windows of one length: pieces are written out, windows are counted per task and tier,
    and a task's windows are numbered on from those of the tasks before it. Only a tier's last group is
    smaller; the windows that are not full, one a task at most, are groups of their own, tier 0.

    Null text counts as empty, an empty text has the one id that closes it. Repeated rows are packed each.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    tiers = tuple(sorted(tiers))
    longest = tiers[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pool, stored, number, in_tier = _encoder(tokenizer), Pool(), {}, 0, dict.fromkeys((0, *tiers), 0)
        task, keys = TaskContext.get().partitionId(), 0
        base = task << 36
        columns: tuple[list, ...] = tuple([] for _ in _NAMES)

        def window(tier: int, pieces: list) -> None:
            nonlocal number
            at, offset = in_tier[tier], 0
            in_tier[tier] += 1
            for key, start, length in pieces:
                doc_id, ids = stored[key]
                values = (doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4,
                          base + number, offset, tier, task, at)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
                offset += length
            number += 1

        def written() -> pa.RecordBatch:
            types = (doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(),
                     pa.int64())
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=list(_NAMES))
            for c in columns:
                c.clear()
            return out

        pooled, doc_type = 0, None
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids += _END.to_bytes(4, "little")
                    stored[keys], n, start = (doc_id, ids), len(ids) // 4, 0
                    while n - start >= longest:
                        window(longest, [(keys, start, longest)])
                        start += longest
                    if start < n:
                        pool.add((keys, start, n - start))
                        pooled += n
                    else:
                        del stored[keys]
                    keys += 1
                if pooled >= _BUFFER_TOKENS:
                    for tier, pieces in pack_pieces(pool, tiers):
                        window(tier, pieces)
                    left = {p[0] for ps in pool.by_length.values() for p in ps}
                    stored = {k: stored[k] for k in left}
                    pooled = 0
                if len(columns[0]) >= 2000:
                    yield written()
        if doc_type is None:
            return
        for tier, pieces in pack_pieces(pool, tiers):
            window(tier, pieces)
        for tier, pieces in last_windows(pool, tiers):
            window(tier, pieces)
        yield written()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    pieces = materialised(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, "
             "offset long, tier int, part int, in_tier long"), "packed-pieces")
    opened = materialised(pieces.where("offset = 0").groupBy("tier", "part").agg(F.count("*").alias("windows")), "packed-counts")
    earlier = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = opened.select(
        F.col("tier").alias("of_tier"), F.col("part").alias("of_part"),
        F.coalesce(F.sum("windows").over(earlier), F.lit(0)).alias("first"))
    group = F.lit(None).cast("long")
    for i, tier in enumerate((0, *tiers)):
        number = F.col("first") + F.col("in_tier")
        group = F.when(F.col("tier") == tier, F.lit(i << 56) + F.floor(number / max(1, step_tokens // (tier or step_tokens)))).otherwise(group)
    if opened.count() <= _SHARED_ROWS:  # a row per task and tier; more are joined by shuffle
        starts = F.broadcast(starts)
    joined = pieces.join(starts, (F.col("tier") == F.col("of_tier")) & (F.col("part") == F.col("of_part")))
    return joined.select(*_NAMES[:-2], group.cast("long").alias("step_group"))


_NAMES = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "part", "in_tier")
