"""Header-to-KPI mapping: match, merge, remember, compare."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kpiloom.functions.similarity import POPULAR_FROM, best_candidate
from kpiloom.schemas import NO_DENOMINATOR, REVIEW_THRESHOLD


_STRANGE = "\u2026"  # stands for a header that is not plain; no plain name equals it
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "  # what Python strips from ASCII text

_SCORE = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("candidate_pos", T.IntegerType()),
])


@lru_cache(maxsize=1 << 16)
def _remembered(header: str, lists: tuple[tuple[str, ...], ...]) -> tuple[float, int]:
    """KPIs that list the same names share the score of a header; of a repeated KPI the best row counts."""
    return max((best_candidate(header, names) for names in lists), key=lambda found: (found[0], -found[1]))


@F.pandas_udf(_SCORE)
def _best_score(header: pd.Series, lists: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [_remembered(h, tuple(map(tuple, n))) for h, n in zip(header, lists)], columns=["score", "candidate_pos"])


_best_score = _best_score.asNondeterministic()  # else a filter on the score runs it a second time


def candidates() -> Column:
    """Names a header may resemble, each once, in order: source fields, numerator, denominator, aliases."""
    listed = F.array_distinct(F.concat(
        F.coalesce("source_fields", F.array().cast("array<string>")),
        F.array("numerator", "denominator"),
        F.coalesce("aliases", F.array().cast("array<string>")),
    ))
    return F.filter(listed, lambda c: c.isNotNull() & (c != NO_DENOMINATOR))


def plain(name: Column) -> Column:
    """A name as the matcher compares it, if it is short ASCII text, else null: only Python knows how others compare."""
    return F.when((F.octet_length(name) == F.length(name)) & (F.length(name) < POPULAR_FROM),
                  F.lower(F.btrim(name, F.lit(_SPACES))))


def header_scores(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Score of each (header, kpi_id): (score, candidate_pos of the first best candidate).

    Only pairs that some upload asks for are scored, each once, however many uploads share it; the
    KPI's own candidates come by an equi-join. ``used`` reads every column of ``pairs``, so that Spark
    takes the pairs from the same shuffle as the caller.
    """
    lists = catalog.groupBy("kpi_id").agg(F.collect_list(candidates()).alias("lists"))
    rest = [c for c in pairs.columns if c not in ("header", "kpi_id")]
    distinct = pairs.groupBy("header", "kpi_id").agg(F.bit_xor(F.xxhash64(*rest)).alias("used"))
    return (
        distinct.where("used is not null").join(lists, "kpi_id")
        .select("header", "kpi_id", _best_score("header", "lists").alias("s"))
        .where("s.candidate_pos >= 0").select("header", "kpi_id", "s.score", "s.candidate_pos")
    )


def match_headers(headers: DataFrame, requests: DataFrame, catalog: DataFrame,
                  key: str = "upload_id", settle: bool = False) -> DataFrame:
    """Best header of each requested catalog KPI, per upload.

    ``headers`` is (key, position, header), ``requests`` (key, kpi_list). The first header, then
    the first candidate, wins a tie, and a score of zero is no match. ``needs_review`` looks at
    the score before rounding. What is joined is as long as an upload's own headers times its
    own KPI list; it is dealt out by (header, KPI) once, for the distinct pairs and for their scores,
    and streams past the scores unsorted, since a header that most uploads have would be one long sort.
    ``settle`` keeps what needs no score out of both shuffles (``settled_first``), with the same result:
    for headers that mostly equal a name. Where most are only similar, it looks at them for nothing.
    """
    if settle:
        best = settled_first(headers, requests, catalog, key)
        score = F.coalesce("best.score", F.lit(0.0))
        return best.select(
            key, "kpi_id", F.col("best.header").alias("raw_column"),
            F.round(score, 2).alias("confidence"), (score < REVIEW_THRESHOLD).alias("needs_review"),
        )
    wanted = restrict(requests, catalog, key)
    pairs = headers.where(F.col("header").isNotNull()).join(wanted.hint("merge"), key).select(
        key, "position", "header", "kpi_id").repartition("header", "kpi_id")
    asked = pairs.join(header_scores(pairs, catalog).hint("shuffle_hash"), ["header", "kpi_id"])
    best = asked.repartition(key, "kpi_id").groupBy(key, "kpi_id").agg(
        F.max(F.struct(
            F.col("score"), (-F.col("position")).alias("p"), (-F.col("candidate_pos")).alias("c"),
            F.col("header"),
        )).alias("best"))
    score = F.coalesce("best.score", F.lit(0.0))
    return wanted.join(best.hint("merge"), [key, "kpi_id"], "left").select(
        key, "kpi_id", F.col("best.header").alias("raw_column"),
        F.round(score, 2).alias("confidence"), (score < REVIEW_THRESHOLD).alias("needs_review"),
    )


def settled_first(headers: DataFrame, requests: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, kpi_id, best) for every requested KPI the catalog has; best is (score, -position, -candidate_pos, header).

    A requested KPI meets its upload's headers as one array. Equal names score 1 and names without a common letter
    0; only pairs of uploads where this does not name the best are dealt out to be scored.
    """
    met = named(requests, catalog, key).join(gathered(headers, key).hint("merge"), key, "left").select(
        key, "kpi_id", F.inline(F.transform(F.array(equal_header()), lambda equal: F.struct(
            equal.alias("best"), open_headers(equal).alias("open")))))
    settled = met.where(F.coalesce(F.size("open"), F.lit(0)) <= 0).select(key, "kpi_id", "best")
    pairs = met.where(F.size("open") > 0).select(key, "kpi_id", F.posexplode("open").alias("nth", "head")).select(
        key, "kpi_id", (F.col("nth") == 0).alias("first"), "head.position", "head.header").repartition("header", "kpi_id")
    asked = pairs.join(header_scores(pairs, catalog).hint("shuffle_hash"), ["header", "kpi_id"], "left").where(
        F.col("first") | F.col("score").isNotNull())
    scored = asked.repartition(key, "kpi_id").groupBy(key, "kpi_id").agg(
        F.max(F.when(F.col("score").isNotNull(), F.struct(
            F.col("score"), (-F.col("position")).alias("p"), (-F.col("candidate_pos")).alias("c"), F.col("header"),
        ))).alias("best"), F.count_if("first").alias("times"))
    return settled.unionByName(scored.select(
        key, "kpi_id", "best", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_")).drop("_"))


def gathered(headers: DataFrame, key: str) -> DataFrame:
    """The headers of each upload, the one that wins a tie first, their positions, and how the matcher compares them.

    The arrays come by a window: it sorts once, and the join takes its order. Null positions are the last and not listed.
    """
    upload = Window.partitionBy(key).orderBy(F.col("position").asc_nulls_last(), F.col("header").desc())
    whole = upload.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return headers.where(F.col("header").isNotNull() & F.col(key).isNotNull()).select(
        key, F.row_number().over(upload).alias("nth"),
        F.collect_list("position").over(whole).alias("positions"), F.collect_list("header").over(whole).alias("headers"),
    ).where("nth = 1").select(key, "positions", "headers", F.transform(
        "headers", lambda h: F.coalesce(plain(h), F.lit(_STRANGE))).alias("texts"))


def equal_header() -> Column:
    """The best header that equals a name of ``lists``, as (score, -position, -candidate_pos, header)."""
    def won(at: Column, nth: Column) -> Column:
        return F.when(at >= 0, F.struct(
            F.lit(1.0).alias("score"), (-F.get("positions", at)).alias("p"), (-nth).alias("c"), F.get("headers", at).alias("header")))

    def best(names: Column) -> Column:
        return F.array_max(F.transform(F.transform(
            names, lambda n: (F.array_position("texts", n) - 1).cast("int")), won))

    return F.when(F.size("lists") == 1, best(F.get("lists", F.lit(0))["names"])).otherwise(
        F.array_max(F.transform("lists", lambda l: best(l["names"]))))


def open_headers(equal: Column) -> Column:
    """Headers to be scored, as (position, header): none if ``equal`` is the best or none shares a letter with a name,
    else all that may be the best."""
    def shares(text: Column, names: Column) -> Column:
        return F.call_function("translate", text, F.array_join(names, ""), F.lit("")) != text

    names = F.get("lists", F.lit(0))["names"]
    known = (F.size("lists") == 1) & names.isNotNull() & ~F.array_contains("texts", _STRANGE) & (
        equal.isNotNull() | ~shares(F.array_join("texts", ""), names))
    every = F.transform("headers", lambda h, nth: F.struct(F.get("positions", nth).alias("position"), h.alias("header")))
    return F.when(known, F.array()).when(equal.isNull(), every).otherwise(
        F.filter(every, lambda h: F.coalesce(h["position"] <= -equal["p"], F.lit(True))))


def named(requests: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, kpi_id, lists) for every requested KPI the catalog has, with the names of each catalog row of the KPI.

    Ids are grouped in a struct, so that the names are dealt out for the join itself: then Spark splits
    an id that most uploads ask for.
    """
    names = F.when(F.forall(candidates(), lambda n: plain(n).isNotNull()), F.transform(candidates(), plain))
    lists = catalog.where(F.col("kpi_id").isNotNull()).groupBy(F.struct("kpi_id").alias("id")).agg(
        F.collect_list(F.struct(names.alias("names"))).alias("lists")).select("id.kpi_id", "lists")
    return requests.select(key, F.explode(F.array_distinct("kpi_list")).alias("kpi_id")).join(lists, "kpi_id")


def restrict(requests: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, kpi_id) for every requested KPI the catalog has."""
    return (
        requests.select(key, F.explode(F.array_distinct("kpi_list")).alias("kpi_id"))
        .join(catalog.select("kpi_id"), "kpi_id", "left_semi")
    )


def review_load(mappings: DataFrame, key: str = "upload_id") -> DataFrame:
    """How many mappings of an upload a person must confirm, and the message shown."""
    return (
        mappings.groupBy(key)
        .agg(F.count_if("needs_review").alias("needs_review_count"))
        .withColumn("message", F.when(
            F.col("needs_review_count") > 0,
            F.concat(F.col("needs_review_count").cast("string"),
                     F.lit(" mapping(s) need user confirmation (confidence < 0.7).")),
        ).otherwise("All mappings auto-resolved. Please confirm to proceed."))
    )


def mapping_coverage(mappings: DataFrame, key: str = "upload_id", least: float = 0.7) -> DataFrame:
    """Share of mappings resolved without review; below ``least`` the upload is escalated."""
    return (
        mappings.groupBy(key)
        .agg(F.count_if(~F.col("needs_review")).alias("mapped"), F.count(F.lit(1)).alias("total"))
        .withColumn("share", F.col("mapped") / F.col("total"))
        .withColumn("escalate", F.col("share") < least)
    )


def check_mapped_columns(mappings: DataFrame, headers: DataFrame, keys: list[str],
                         key: str = "upload_id") -> DataFrame:
    """Whether the numerator and denominator columns of each mapping are in the file.

    A mapping without a numerator column is judged by its raw column. Each mapping is split into its
    two names, which meet the headers in one equi-join on (upload, column name), so one wide or popular
    file does not gather in one task. ``is_total`` marks KPIs without a denominator.
    """
    known = headers.select(key, F.col("header").alias("_name"), F.lit(True).alias("_there")).distinct()
    if "raw_column" in mappings.columns:
        named = F.coalesce(F.nullif(F.col("numerator_column"), F.lit("")), F.col("raw_column"))
        mappings = mappings.withColumn("numerator_column", named)
    sides = mappings.select(
        key, *keys, "is_total", "numerator_column", "denominator_column",
        F.posexplode(F.array("numerator_column", "denominator_column")).alias("_side", "_name"))
    found = sides.join(known, [key, "_name"], "left")

    def there(side: int) -> Column:
        return F.bool_or((F.col("_side") == side) & F.coalesce(F.col("_there"), F.lit(False)))

    checked = found.groupBy(key, *keys, "is_total", "numerator_column", "denominator_column").agg(
        there(0).alias("has_numerator"), there(1).alias("has_denominator"))

    def gap(prefix: str, column: str) -> Column:
        return F.concat(F.lit(f"{prefix}column '"), F.coalesce(F.col(column), F.lit("None")),
                        F.lit("' missing"))

    flag = (
        F.when(~F.col("has_numerator") & F.col("is_total"), gap("", "numerator_column"))
        .when(~F.col("has_numerator"), gap("numerator ", "numerator_column"))
        .when(~F.col("is_total") & ~F.col("has_denominator"),
              gap("denominator ", "denominator_column"))
    )
    return checked.withColumn("flag", flag).select(key, *keys, "has_numerator", "has_denominator", "flag")


def merge_whole(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """An incoming mapping record replaces the stored record of its KPI entirely.

    Records are maps from field name to value, one row per (request, KPI).
    """
    new = incoming.select(*keys, F.col("record").alias("_new"))
    return (
        current.join(new, keys, "full_outer")
        .withColumn("record", F.coalesce("_new", "record")).drop("_new")
    )


def merge_fields(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Fields present in the incoming record win, a null value included; others stay."""
    new = incoming.select(*keys, F.col("record").alias("_new"))
    none = F.create_map().cast("map<string,string>")
    old, fresh = F.coalesce("record", none), F.coalesce("_new", none)
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return (
        current.join(new, keys, "full_outer")
        .withColumn("record", F.map_concat(kept, fresh)).drop("_new")
    )


def lookup_memory(requests: DataFrame, memory: DataFrame) -> DataFrame:
    """Stored mapping for the client and template of each request; an empty key has none."""
    remembered = memory.select(
        "client_id", "template_type", "mappings", "use_count", F.lit(True).alias("_found"))
    given = (F.coalesce("client_id", F.lit("")) != "") & (F.coalesce("template_type", F.lit("")) != "")
    return (
        requests.join(remembered, ["client_id", "template_type"], "left")
        .withColumn("exists", given & F.coalesce("_found", F.lit(False)))
        .withColumn("mappings", F.when(F.col("exists"), F.col("mappings")))
        .withColumn("use_count", F.when(F.col("exists"), F.col("use_count")))
        .drop("_found")
    )


def upsert_memory(memory: DataFrame, approvals: DataFrame) -> DataFrame:
    """Mapping memory after a batch of approvals (client_id, template_type, seq, mappings, approved_by).

    The latest approval of a key gives its mapping and approver; every approval counts one use.
    """
    keys = ["client_id", "template_type"]
    batch = approvals.groupBy(*keys).agg(
        F.max_by(F.struct("mappings", "approved_by"), "seq").alias("_last"),
        F.count(F.lit(1)).alias("_uses"),
    )
    return memory.join(batch, keys, "full_outer").select(
        *keys,
        F.coalesce("_last.mappings", "mappings").alias("mappings"),
        F.coalesce("_last.approved_by", "approved_by").alias("approved_by"),
        (F.coalesce("use_count", F.lit(0)) + F.coalesce("_uses", F.lit(0))).cast("bigint")
        .alias("use_count"),
    )


def header_drift(stored: Column, current: Column) -> tuple[Column, Column, Column]:
    """Headers gone, headers added, and whether both lists hold the same names."""
    gone, added = F.array_except(stored, current), F.array_except(current, stored)
    return gone, added, (F.size(gone) == 0) & (F.size(added) == 0)
