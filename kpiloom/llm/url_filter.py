"""URL filter: a blocked Bloom filter of the listed URLs passes possible hits to an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import materialised

_LANES = 8  # a block has eight lanes of 32 bits, each holding one bit of every key
_ADDED = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with all its subdomains and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host, path without a closing slash, and query without ``utm_`` parameters; scheme and fragment go.
    Null or no ``://``: null, as such a text names no place that a list could hold."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_") & (p != "")), "&")
    place = F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""))
    return F.when(text.contains("://"), F.concat(place, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _lane_bit(key: Column, lane: int) -> Column:
    """The bit of one lane, from a hash of its own."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(lane)), F.lit(32)).cast("int"))


def bloom_filter(listed: DataFrame, url: str, bits_per_url: int = 16, max_blocks: int = 1 << 16) -> tuple[DataFrame, int]:
    """(block, lanes) for the non-empty blocks, and the number of blocks.

    The filter grows with the list up to ``max_blocks`` (4 MB of lanes at the default) and no further, which
    bounds what is broadcast; a longer list only lets more URLs through to the exact join.
    """
    n = listed.count()
    blocks = 1
    while blocks * 32 * _LANES < n * bits_per_url and blocks < max_blocks:
        blocks *= 2
    keyed = listed.select(F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), F.col(url))
    lanes = keyed.groupBy("block").agg(
        *[F.bit_or(_lane_bit(F.col(url), i)).alias(f"lane{i}") for i in range(_LANES)])
    return lanes.select("block", F.array(*[f"lane{i}" for i in range(_LANES)]).alias("lanes")), blocks


def judge(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), bits_per_url: int = 16,
    max_blocks: int = 1 << 16,
) -> DataFrame:
    """All columns of ``pages`` with host, path, rule and verdict (columns of these names are replaced).

    The longest rule that fits decides. Pages that no rule fits are blocked if ``listed`` (column ``url``)
    holds their canonical URL, and allowed otherwise: the filter is joined to every page by its block, only
    possible hits are shuffled to the exact join, and that join removes the false ones. The exact side has
    each URL once and is joined by hash, so a URL with a third of all rows can be split.

    Null URLs and texts without ``://`` have an empty host and path, fit no rule and are on no list. An
    empty list blocks nothing. Repeated pages are each judged.
    """
    exact = materialised(
        listed.select(canonical(F.col("url")).alias("listed_url")).where("listed_url is not null").distinct(),
        "url-list")
    lanes, blocks = bloom_filter(exact, "listed_url", bits_per_url, max_blocks)
    lanes = lanes.select(F.col("block").alias("filter_block"), F.col("lanes").alias("filter_lanes"))
    kept = [c for c in pages.columns if c not in _ADDED]
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path"),
                        canonical(F.col("url")).alias("place"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})

    asked = rows.withColumn("block", F.when(F.col("rule").isNull(), F.pmod(F.xxhash64("place"), F.lit(blocks))))
    probed = asked.join(F.broadcast(lanes), F.col("block") == F.col("filter_block"), "left")
    hit = F.col("place").isNotNull() & F.col("filter_lanes").isNotNull()
    for i in range(_LANES):
        hit = hit & (F.col("filter_lanes")[i].bitwiseAND(_lane_bit(F.col("place"), i)) != 0)
    probed = probed.withColumn("possible", hit)
    columns = [*[F.col(f"row.{c}").alias(c) for c in kept], "host", "path", "rule"]
    clear = probed.where(~F.col("possible")).select(
        *columns, F.coalesce(F.col("verdict"), F.lit("allow")).alias("verdict"))
    hits = probed.where("possible").join(exact, F.col("place") == F.col("listed_url"), "left").select(
        *columns, F.when(F.col("listed_url").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return clear.union(hits)
