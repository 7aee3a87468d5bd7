"""Quality rules: counts of each text, and the log-likelihood ratio of its hashed n-grams between a trusted
target and the raw corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import materialised, words

SYMBOLS = "#*$%&|<>"
_UNIT = 1 << 20  # a ratio is kept in whole 2^-20 of a nat, so sums don't depend on their order
_SHARED_IDS = 1_000_000
_ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def hashes_of(ws: Column) -> Column:
    """Each word's hash, from which n-grams are hashed: a word's letters are read once."""
    return F.transform(ws, lambda w: F.xxhash64(w))


def buckets_of(hs: Column, buckets: int) -> Column:
    """The bucket of each word and of each pair of neighbours, from the words' hashes."""
    pairs = F.transform(F.slice(hs, F.lit(1), F.greatest(F.size(hs) - 1, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hs, i + 1)))
    return F.transform(F.concat(hs, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def buckets_for(size: int) -> int:
    """The power of two that reaches eight times the root of the number of n-grams, 65,536 at least: the
    vocabulary of a text grows with about the root of its length. ``size``: UTF-8 bytes of all texts, of
    which three are taken for an n-gram, so that the texts need not be split once more only to be counted."""
    return 1 << max(16, math.ceil(math.log2(8 * math.sqrt(max(size / 3, 1)))))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, hit): n-grams of all texts and of all trusted ones; every task sums its own part first. Counted to be
    few, the trusted ids are broadcast and texts stay where they are; more are joined by shuffle."""
    ids = materialised(trusted.where("doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct(), "rule-trusted")
    if ids.count() <= _SHARED_IDS:
        ids = F.broadcast(ids)
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    # Hashes are a column of their own first: an expression would be split again for every word.
    hashed = marked.select("trusted_id", hashes_of(words(F.col("text"))).alias("hs"))
    grams = hashed.select("trusted_id", F.explode(buckets_of(F.col("hs"), buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted_id").alias("hit"))


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int, prior: float) -> DataFrame:
    """(bucket, v): the log ratio of every bucket that occurs, in units of 2^-20 nat. The raw side is smoothed by
    one count a bucket, the target by ``prior`` counts spread like the raw side."""
    counts = materialised(bucket_counts(docs, trusted, buckets), "rule-counts")
    n_raw, n_hit = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("hit"), F.lit(0))).first()
    p_raw = (F.col("raw") + 1) / float(n_raw + buckets)
    p_hit = (F.col("hit") + prior * p_raw) / float(n_hit + prior)
    return counts.select("bucket", F.round(F.ln(p_hit / p_raw) * _UNIT).cast("int").alias("v"))


def _as_array(table: DataFrame, buckets: int) -> DataFrame:
    """One row: the ratios of ``table`` by bucket; a bucket that no text has is never asked for."""
    every = table.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    entries = every.join(table, "bucket", "left").select(F.struct("bucket", "v").alias("entry"))
    return entries.agg(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["v"]).alias("ratios"))


def _totals(rows: DataFrame, table: DataFrame, buckets: int) -> DataFrame:
    """(of_row, total): the sum of the ratios of each row's n-grams, by a join on the bucket. A text's equal
    n-grams are one row, and frequent buckets are partitions that Spark may split."""
    grams = rows.select(F.col("row_no").alias("of_row"), F.explode(buckets_of(F.col("hs"), buckets)).alias("bucket"))
    counted = grams.groupBy("of_row", "bucket").agg(F.count("*").alias("n"))
    return counted.join(table, "bucket").groupBy("of_row").agg(F.sum(F.col("n") * F.col("v")).alias("total"))


def judge(
    docs: DataFrame, trusted: DataFrame, threshold: float = -0.3, buckets: int | None = None,
    prior: float = 1000.0, min_words: int = 10, max_repeat_percent: int = 20, shared_buckets: int = 1 << 22,
) -> DataFrame:
    """All columns of ``docs`` with the counts, ``llr`` (mean ratio per n-gram, in nats) and ``kept``.

    A document is kept if it passes the base rules and its ``llr`` reaches ``threshold``. ``trusted``
    (doc_id) names target documents. Counts cover all documents, trusted and raw, in ``buckets`` buckets, by
    default ``buckets_for`` the corpus. Up to ``shared_buckets`` of them (16 MB) all tasks share one array
    of ratios and texts are scored where they are read; more are joined as a table, with the same sums.
    For the counts texts are shuffled only beyond a million trusted ids.

    Null text counts as empty: no words, base_failed, llr 0. Repeated rows are counted and judged each.
    Columns of the added names are replaced. With no trusted documents every ratio is near 0 and only the
    base rules decide. An empty table gives an empty table.
    """
    buckets = buckets or buckets_for(text_bytes(docs))
    table = ratios(docs, trusted, buckets, prior)
    kept = [c for c in docs.columns if c not in _ADDED]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*kept).alias("row"), text.alias("body"), words(F.col("text")).alias("ws")).select(
        "row", "body", hashes_of(F.col("ws")).alias("hs"), F.length(F.array_join("ws", "")).alias("word_chars"))
    if buckets > shared_buckets:
        rows = numbered = materialised(rows.withColumn("row_no", F.monotonically_increasing_id()), "rule-rows")
    n = F.size("hs")
    shingles = F.transform(
        F.slice("hs", F.lit(1), F.greatest(n - 4, F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get("hs", i + k) for k in range(1, 5)]))
    rows = rows.withColumns({
        "shingles": shingles,
        "lines": F.filter(F.split("body", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
    })
    repeats = F.size(F.array_distinct("shingles")) < F.size("shingles")
    ordered = F.sort_array(F.transform("shingles", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(repeats, ordered))
    twice = F.filter(
        "ordered", lambda s, i: (s["h"] == F.get("ordered", i - 1)["h"]) | (s["h"] == F.get("ordered", i + 1)["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda s: F.sequence(s["i"], s["i"] + 4)))))
    if buckets <= shared_buckets:
        rows = rows.withColumn("ratios", _as_array(table, buckets).scalar())
        total = F.aggregate(
            buckets_of(F.col("hs"), buckets), F.lit(0).cast("long"), lambda s, b: s + F.get("ratios", b))
    else:
        totals = _totals(numbered, table, buckets)
        rows = rows.join(totals, F.col("row_no") == F.col("of_row"), "left")
        total = F.coalesce(F.col("total"), F.lit(0))
    counted = rows.select(
        "row", n.cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("ordered").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        (total / F.lit(float(_UNIT)) / F.greatest(2 * n - 1, F.lit(1))).alias("llr"))
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select(
        *[F.col(f"row.{c}").alias(c) for c in kept], "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"))
