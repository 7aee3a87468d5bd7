"""Near copies: candidates by SimHash fingerprints in vantage-point trees, then the exact Jaccard similarity of shingles.

At similarity 0.8 a bit of two SimHash fingerprints differs with a probability of 0.15 (0.16 for the smallest sets),
so such pairs differ in up to 17 of 64 bits, a radius at which no tree over whole fingerprints prunes anything.
Fingerprints here have 1,024 bits, cut into 80 pieces of 12, and each piece has a vantage-point tree of its own. Sets
that agree in a piece meet in a leaf of its tree, however deep that is; at 0.8 a pair agrees in none of the pieces in
1 of 100,000 cases. Leaves are searched exactly for fingerprints at most 37 of 128 bits apart, which a pair at 0.8 is
but in 1 of 100,000 cases. All pairs found close in a leaf are compared on their whole sets, except those that other
links have made one class already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import components, materialised
from kpiloom.llm.simhash import hang, shingle_hashes, vantage_points

WORDS, PIECES, PIECE_BITS = 16, 80, 12
_PER_WORD, _CLOSE_WORDS, _CLOSE_BITS = PIECES // WORDS, 2, 37
_LEAF_ROWS, _SAMPLE_ROWS, _CELL_ROWS = 512, 4096, 8192
_TURNS = 1
_BLOCK_NODES, _BLOCK_SHINGLES = 512, 500_000
_SALTS = (np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def _bits(shingles: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each hash: its own bits, then those of its rehashes."""
    z = shingles[:, None] + _SALTS
    z[:, 1:] = (z[:, 1:] ^ (z[:, 1:] >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z[:, 1:] = (z[:, 1:] ^ (z[:, 1:] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z[:, 1:] ^= z[:, 1:] >> np.uint64(31)
    return np.unpackbits(z.view(np.uint8).reshape(len(z), WORDS * 8), axis=1, bitorder="little")


_SHARED = _bits(np.array([0x5851F42D4C957F2D], dtype=np.uint64))[0].astype(np.int64)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The words of a set's SimHash: a bit is set if it is set in over half the hashes. One shingle that all sets
    have is counted with them, which leaves small sets fewer ties."""
    counts = _SHARED.copy()
    for i in range(0, len(shingles), 255):
        counts += np.add.reduce(_bits(shingles[i : i + 255]), axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(shingles) + 1, bitorder="little").view(np.uint64)


def _described(text: str | None, shingle: int) -> tuple[bytes, int, list[int]]:
    """(node, n, bands): the node names the set by 128 bits, so equal sets have the same and others do not; the
    bands are the words of its fingerprint."""
    shingles = np.unique(shingle_hashes(text, shingle))
    node = xxhash.xxh3_128_digest(shingles.tobytes())
    return node, len(shingles), fingerprint(shingles).view(np.int64).tolist() if len(shingles) else []


def _with_key(docs: DataFrame) -> DataFrame:
    """Adds ``row_key``, (doc_id, hashes of the text); as a struct it compares equal where both ids are null."""
    return docs.withColumn("row_key", F.struct(
        F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.xxhash64(F.lit(1), "text").alias("other_hash")))


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """(row_key, node, n, bands) of every document."""
    keyed = _with_key(docs.select("doc_id", "text")).select("row_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_described(t.as_py(), shingle) for t in batch.column(1)]
            node, n, bands = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, pa.binary()), pa.array(n, pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
                names=["row_key", "node", "n", "bands"])

    key = keyed.schema["row_key"].dataType.simpleString()
    return keyed.mapInArrow(run, f"row_key {key}, node binary, n int, bands array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(of_node, shingles) of each of ``nodes`` (node, least: the row that stands for it)."""
    texts = _with_key(docs.select("doc_id", "text")).join(nodes.select(F.col("least").alias("row_key"), "node"), "row_key")
    texts = texts.dropDuplicates(["row_key"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # texts may be long: one row at a time
                one = np.unique(shingle_hashes(batch.column(1)[i].as_py(), shingle)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([one], pa.list_(pa.int64()))], names=["of_node", "shingles"])

    return texts.mapInArrow(run, "of_node binary, shingles array<long>")


def _rooted(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``buckets`` with the class that each node is in so far."""
    named = roots.withColumnRenamed("node", "of_node")
    return buckets.join(named, F.col("node") == F.col("of_node"), "left").select(
        "bucket", "node", "n", F.coalesce("root", "node").alias("root"))


def hub_links(buckets: DataFrame, sets: DataFrame, roots: DataFrame, turn: int, percent: int) -> DataFrame:
    """Links (a, b) between the nodes of each bucket that is not one class and one node of it. The order in which
    nodes are taken is the same in all buckets of a turn; a node of several buckets meets the first of their nodes."""
    rooted = _rooted(buckets, roots)
    hubs = rooted.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"),
        F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("at"), "node", "n", "root")).alias("hub"),
    ).where("low < high").select("bucket", "hub")
    met = rooted.join(hubs, "bucket").where("root <> hub.root").where(
        100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    pairs = met.groupBy(F.col("node").alias("a")).agg(F.min("hub").alias("hub")).select("a", F.col("hub.node").alias("b"))
    left = sets.select(F.col("of_node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("of_node").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * either).select("a", "b")


def similar_pairs(sets: list[np.ndarray], split: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of sets that are similar, ``i`` of the first ``split`` sets and ``j`` of the
    others, or i < j of all if nothing is after the split. Common elements are counted by a product of 0/1
    matrices, taken over some thousand elements at a time."""
    sizes = np.array([len(s) for s in sets])
    owner, values = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, element, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[element] > 1
    owner, element = owner[keep], np.unique(element[keep], return_inverse=True)[1]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    left, right = (split, len(sets) - split) if split < len(sets) else (split, split)
    common = np.zeros((left, right), dtype=np.float32)
    width = 4096
    edges = np.searchsorted(element, np.arange(0, (element[-1] if len(element) else -1) + width + 1, width))
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            held = np.zeros((len(sets), width), dtype=np.float32)
            held[owner[a:b], element[a:b] - k * width] = 1
            common += held[:left] @ held[len(sets) - right :].T
    either = sizes[:left, None] + sizes[None, len(sets) - right :] - common
    i, j = np.nonzero(100 * common.astype(np.float64) >= percent * either)
    if split == len(sets):
        i, j = i[i < j], j[i < j]
    else:
        j = j + split
    return i, j


def spanning(n: int, i: np.ndarray, j: np.ndarray, label: list) -> list[tuple[int, int]]:
    """Of the links (i, j) as many as connect what they connect, given that equal labels are one already."""
    first: dict = {}
    root = [first.setdefault(x, k) for k, x in enumerate(label)]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def bucket_links(buckets: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what all pairs of a bucket connect, for each bucket that is not one class.

    A bucket is cut into blocks of some hundred nodes by hash, and every two blocks are one cell, whose pairs
    are compared on whole sets inside a task and leave it as a spanning forest: nothing is as large as the
    square of a bucket but the comparisons. Buckets with the same nodes are compared once.
    """
    rooted = _rooted(buckets, roots)
    per_bucket = rooted.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.sum("n").alias("size"),
        F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x2"),
        F.min("node").alias("least")).where("low < high")
    once = per_bucket.groupBy("members", "size", "x1", "x2", "least").agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("members") / _BLOCK_NODES), F.ceil(F.col("size") / _BLOCK_SHINGLES)).cast("long")
    opened = rooted.join(once.select(F.col("bucket").alias("of_bucket"), blocks.alias("blocks")),
                         F.col("bucket") == F.col("of_bucket"))
    block = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks"))
    dealt = opened.withColumn("block", block).select(
        "bucket", "block", "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = dealt.select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")
    rows = cells.join(sets, F.col("node") == F.col("of_node")).select("bucket", "i", "j", "block", "node", "root", "shingles")

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block", "node"])
        nodes, root = frame["node"].tolist(), [bytes(r) for r in frame["root"]]
        split = int((frame["block"] == frame["i"]).sum()) if frame["i"].iat[0] != frame["j"].iat[0] else len(frame)
        if not 0 < split or len(frame) < 2 or (split == len(frame) and frame["i"].iat[0] != frame["j"].iat[0]):
            return pd.DataFrame({"a": [], "b": []})
        i, j = similar_pairs([np.asarray(s) for s in frame["shingles"]], split, percent)
        links = spanning(len(nodes), i, j, root)
        return pd.DataFrame({"a": [nodes[x] for x, _ in links], "b": [nodes[y] for _, y in links]})

    return rows.groupBy("bucket", "i", "j").applyInPandas(cell, "a binary, b binary")


def medians(words: np.ndarray) -> np.ndarray:
    """(piece, level): the distance from the level's vantage point that halves the sample most evenly."""
    out = np.full((PIECES, PIECE_BITS - 1), PIECE_BITS // 2)
    for p in range(PIECES if len(words) else 0):
        own = _piece(words, p)
        for level, v in enumerate(vantage_points(PIECE_BITS)):
            below = np.cumsum(np.bincount(np.bitwise_count(own ^ v), minlength=PIECE_BITS + 1)) / len(own)
            out[p, level] = int(np.abs(below - 0.5).argmin()) + 1
    return out


def _piece(words: np.ndarray, p: int) -> np.ndarray:
    shift, mask = np.uint64(PIECE_BITS * (p % _PER_WORD)), np.uint64((1 << PIECE_BITS) - 1)
    return words[:, p // _PER_WORD] >> shift & mask


def leaves_of(words: np.ndarray, depth: int, cuts: np.ndarray) -> np.ndarray:
    """(row, piece): the leaf of the piece's tree that holds the fingerprint."""
    out = np.empty((len(words), PIECES), dtype=np.int64)
    for p in range(PIECES):
        own, leaf = _piece(words, p), np.full(len(words), p, dtype=np.int64)
        for level, v in enumerate(vantage_points(PIECE_BITS)[:depth]):
            leaf = leaf * 2 + (np.bitwise_count(own ^ v) >= cuts[p, level])
        out[:, p] = leaf
    return out


def close_groups(n: np.ndarray, words: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """For each row of a leaf the first one that close pairs connect it with: fingerprints at most 37 of 128 bits
    apart, of sets whose sizes allow the similarity. Of two ``side``s, only pairs across them."""
    order = np.argsort(n, kind="stable")
    n, words, side = n[order], words[order], side[order]
    root, two = np.arange(len(n)), len(side) > 0 and side.min() != side.max()
    for i in range(0, len(n), 256):
        end = min(i + 256, len(n))
        high = np.searchsorted(n, n[end - 1] * 100 // percent, side="right")
        apart = np.zeros((end - i, high - i), dtype=np.uint16)
        for w in range(words.shape[1]):
            apart += np.bitwise_count(words[i:end, w, None] ^ words[None, i:high, w])
        near = (apart <= _CLOSE_BITS) & (100 * n[i:end, None] >= percent * n[None, i:high])
        if two:
            near &= side[i:end, None] != side[None, i:high]
        a, b = np.nonzero(np.triu(near, 1))
        hang(root, a + i, b + i)
    out = np.empty_like(root)
    out[order] = order[root]
    return out


def _dealt(nodes: DataFrame) -> DataFrame:
    """(leaf, cell, side, node, n, w0, w1): each node in a leaf of every tree. The depth follows the number of nodes;
    a sample sets the medians, which only decide how even the leaves are. Leaves of many thousand rows are cut into
    blocks by the nodes' names, and every two blocks are one cell, whose pairs across its sides are searched."""
    searched = nodes.where(F.size("bands") > 0).select("node", "n", "bands")
    rows = searched.count()
    depth = min(PIECE_BITS - 1, max(0, math.ceil(math.log2(max(1, rows) / _LEAF_ROWS))))
    sample = searched.orderBy(F.xxhash64(F.lit(1), "node")).limit(_SAMPLE_ROWS).collect() if depth else []
    cuts = medians(np.array([r["bands"] for r in sample], dtype=np.int64).view(np.uint64).reshape(-1, WORDS))

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                words = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                yield batch, words.view(np.uint64).reshape(-1, WORDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(PIECES << depth, dtype=np.int64)
        for _, words in fingerprints(batches):
            held += np.bincount(leaves_of(words, depth, cuts).ravel(), minlength=len(held))
        leaf = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(held[leaf])], names=["leaf", "members"])

    blocks = np.ones(PIECES << depth, dtype=np.int64)
    if rows > _CELL_ROWS:
        sizes = searched.mapInArrow(count, "leaf long, members long").groupBy("leaf").agg(F.sum("members").alias("members"))
        for r in sizes.where(F.col("members") > _CELL_ROWS).collect():
            blocks[r["leaf"]] = -(-r["members"] // _CELL_ROWS) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in fingerprints(batches):
            leaf, row = leaves_of(words, depth, cuts).ravel(), np.repeat(np.arange(len(words)), PIECES)
            name = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64)[::2]
            many = blocks[leaf]
            at = np.repeat(np.arange(len(leaf)), many)
            leaf, row, many = leaf[at], row[at], many[at]
            other = np.arange(len(at)) - np.searchsorted(at, at)
            block = (name[row] % many.astype(np.uint64)).astype(np.int64)
            cell = np.minimum(block, other) * many + np.maximum(block, other)
            columns = [pa.array(leaf), pa.array(cell), pa.array((block > other).astype(np.int32))]
            columns += [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))]
            columns += [pa.array(words[row, w].view(np.int64)) for w in range(_CLOSE_WORDS)]
            yield pa.RecordBatch.from_arrays(columns, names=["leaf", "cell", "side", "node", "n", "w0", "w1"])

    return searched.mapInArrow(run, "leaf long, cell long, side int, node binary, n int, w0 long, w1 long")


def close_buckets(nodes: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, n): the nodes that close pairs of a leaf connect are one bucket, named by its nodes, so that
    the same nodes found in several trees are one bucket."""

    def groups(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, node, n, *words = (pa.concat_arrays([b.column(k) for b in held]) for k in range(2, 7))
        if len(node) < 2:
            return
        words = np.stack([w.to_numpy().view(np.uint64) for w in words], axis=1)
        root = close_groups(n.to_numpy(), words, side.to_numpy(), percent)
        size = np.bincount(root, minlength=len(root))
        rows = np.flatnonzero(size[root] > 1)
        if not len(rows):
            return
        rows = rows[np.argsort(root[rows], kind="stable")]
        names, bucket = node.take(pa.array(rows)).to_pylist(), []
        for a, b in _runs(root[rows]):
            name = xxhash.xxh64_intdigest(b"".join(sorted(names[a:b])))
            bucket += [name - (1 << 64) if name >> 63 else name] * (b - a)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int64()), pa.array(names, pa.binary()), n.take(pa.array(rows))], names=["bucket", "node", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            leaf, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in _runs(leaf, cell):
                if (leaf[a], cell[a]) != last:
                    if held:
                        yield from groups(held)
                    held, last = [], (leaf[a], cell[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from groups(held)

    dealt = _dealt(nodes).repartition("leaf", "cell").sortWithinPartitions("leaf", "cell")
    return dealt.mapInArrow(search, "bucket long, node binary, n int").distinct()


def _runs(*columns: np.ndarray) -> zip:
    """(start, end) of each run of equal values."""
    if not len(columns[0]):
        return zip((), ())
    new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    return zip([0, *new.tolist()], [*new.tolist(), len(columns[0])], strict=True)


def links(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, root) of the nodes linked to a smaller one, over all pairs that are close in a leaf.

    A first turn compares the nodes of a bucket with one of them, which makes many groups one class; what is left
    open is compared pair by pair. Pairs inside a class are left out, which changes no class.
    """
    buckets = materialised(close_buckets(nodes, percent), "near-buckets")
    found = nodes.sparkSession.createDataFrame([], "a binary, b binary")
    roots = found.toDF("node", "root")
    if buckets.isEmpty():
        return roots
    held = nodes.join(buckets.select("node").distinct(), "node", "left_semi")
    sets = materialised(shingle_sets(docs, held, shingle), "near-sets")
    for turn in range(_TURNS + 1):
        new = hub_links(buckets, sets, roots, turn, percent) if turn < _TURNS else bucket_links(buckets, sets, roots, percent)
        new = materialised(new, "near-links")
        if not new.isEmpty():
            found = found.union(new)
            roots = components(found, "near-components")
    return roots


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class of near copies: texts are linked whose sets of ``shingle``-word
    shingles (A-Z in lower case) have a Jaccard similarity of ``percent`` or more, and classes are what links
    connect. The row with the smallest (doc_id, hash of the text) stays, null ids last; of repeated rows one.

    Texts of fewer words are one shingle; all without words, null ones too, are one class. Equal sets are one
    node before any search, so copies cost nothing there. An empty table gives an empty table.
    """
    rows = described(docs, shingle)
    nodes = materialised(rows.groupBy("node").agg(
        F.min("row_key").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-nodes")
    roots = links(docs, nodes, shingle, percent).withColumnRenamed("node", "of_node")
    rooted = nodes.join(roots, nodes["node"] == roots["of_node"], "left").select(
        F.coalesce("root", "node").alias("root"), "least")
    kept = rooted.groupBy("root").agg(F.min("least").alias("row_key")).select("row_key")
    return _with_key(docs).join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*docs.columns)
