"""Requests, review queue and decisions as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kpiloom.schemas import TEMPLATE_IDS


def requests_of(requests: DataFrame, created_by: str | None = None) -> DataFrame:
    """Newest first; ties by id."""
    if created_by:
        requests = requests.where(F.col("created_by") == created_by)
    return requests.orderBy(F.desc("created_at"), "request_id")


def validate_intake(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Error of each intake, template first, then the KPI ids the catalog lacks in request order.

    Accepted intakes also list the KPIs still unreviewed; a rejected one has none listed. Every (request, KPI) row finds its
    catalog row by an equi-join; what is gathered back is as long as the request's own list.
    """
    listed = requests.select("request_id", F.posexplode("kpi_list").alias("p", "kpi_id"))
    known = catalog.select("kpi_id", "reviewed", F.lit(True).alias("_known"))
    status = (
        listed.join(known, "kpi_id", "left")
        .where(F.col("_known").isNull() | ~F.coalesce("reviewed", F.lit(False)))
        .groupBy("request_id")
        .agg(F.sort_array(F.collect_list(F.struct("p", "kpi_id", "_known"))).alias("_open"))
    )

    def ids(condition):
        return F.transform(F.filter("_open", condition), lambda o: o["kpi_id"])

    empty = F.array().cast("array<string>")
    missing = F.coalesce(ids(lambda o: o["_known"].isNull()), empty)
    pending = F.coalesce(ids(lambda o: o["_known"].isNotNull()), empty)

    def shown(column: str):
        return F.concat(F.lit("['"), F.array_join(column, "', '"), F.lit("']"))

    bad_template = ~F.coalesce(F.col("template_type").isin(TEMPLATE_IDS), F.lit(False))
    return (
        requests.join(status, "request_id", "left")
        .withColumn("missing_kpis", missing)
        .withColumn("unreviewed_kpis", pending)
        .withColumn(
            "error",
            F.when(bad_template, F.concat(
                F.lit("Unknown template '"), F.coalesce("template_type", F.lit("None")),
                F.lit(f"'. Choose from: {TEMPLATE_IDS}")))
            .when(F.size("missing_kpis") > 0, F.concat(
                F.lit("KPI IDs not found in catalog: "), shown("missing_kpis"))),
        )
        .withColumn("accepted", F.col("error").isNull())
        .withColumn("unreviewed_kpis", F.when(F.col("accepted"), F.col("unreviewed_kpis"))
                    .otherwise(empty)).drop("_open")
    )


def review_queue(entries: DataFrame, requests: DataFrame,
                 status: str | None = "pending") -> DataFrame:
    """Review entries with their request, newest entry first.

    All columns of the request come along, so the reviewer sees its computed KPIs and data quality
    flags; where both sides have a column, the entry's own stays.
    """
    if status:
        entries = entries.where(F.col("status") == status)
    own = set(entries.columns) - {"request_id"}
    carried = requests.select(*[c for c in requests.columns if c not in own])
    return entries.join(carried, "request_id").orderBy(F.desc("entry_seq"))


def new_kpis(entries: DataFrame, requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Unreviewed catalog KPIs of each review entry's request, by list position.

    ``requested`` is (request_id, position, kpi_id).
    """
    open_kpis = catalog.where(~F.col("reviewed")).select("kpi_id", "display_name")
    return (
        entries.select("entry_id", "request_id").join(requested, "request_id")
        .join(open_kpis, "kpi_id")
        .select("entry_id", "position", "kpi_id", "display_name")
    )


def new_kpi_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("entry_id").agg(F.count(F.lit(1)).alias("count"))


def apply_decisions(entries: DataFrame, requests: DataFrame,
                    decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and requests after a batch of approvals and rejections.

    ``decisions`` is (entry_id, seq, decision, reviewer_notes, overrides, reviewed_at); the latest
    decision of an entry counts, and of a request's entries the one decided last. Empty
    overrides are stored as null; a rejection carries none.
    """
    last = decisions.groupBy("entry_id").agg(
        F.max(F.struct("seq", "decision", "reviewer_notes", "reviewed_at")).alias("d"),
        F.max_by("overrides", "seq").alias("_overrides"),
    )
    keep = (F.col("d.decision") == "approved") & (F.coalesce(F.size("_overrides"), F.lit(0)) > 0)
    joined = entries.join(last, "entry_id", "left")
    decided = F.col("d").isNotNull()
    updated = joined.withColumns({
        "status": F.coalesce("d.decision", "status"),
        "reviewer_notes": F.when(decided, F.coalesce("d.reviewer_notes", F.lit("")))
        .otherwise(F.col("reviewer_notes")),
        "overrides": F.when(decided, F.when(keep, F.col("_overrides")))
        .otherwise(F.col("overrides")),
        "reviewed_at": F.coalesce("d.reviewed_at", "reviewed_at"),
    }).drop("d", "_overrides")
    outcome = joined.where(decided).groupBy("request_id").agg(
        F.max_by("d.decision", "d.seq").alias("_decision"))
    requests = (
        requests.join(outcome, "request_id", "left")
        .withColumn("status", F.coalesce("_decision", "status")).drop("_decision")
    )
    return updated, requests


def enqueue_reviews(reports: DataFrame) -> DataFrame:
    """One pending entry per generated report.

    The id is derived from the request and its run, so a retried task writes the same entry.
    """
    return reports.select(
        F.sha2(F.concat_ws(":", "request_id", F.col("run_seq").cast("string")), 256)
        .substr(1, 32).alias("entry_id"),
        "request_id", F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("reviewer_notes"),
    )


def latest_state(updates: DataFrame, fields: Sequence[str], key: str = "request_id",
                 seq: str = "seq", at: str = "updated_at") -> DataFrame:
    """Field-wise last write per request from an append-only update log.

    An update sets the fields it carries in ``changes`` (a map); a field it does not carry keeps
    its last value. Maxima fold before the shuffle, however many updates one request has.
    """
    folded = updates.groupBy(key).agg(*latest_fields(fields, seq), F.max(at).alias(at))
    return shown_fields(folded, fields, key, at)


def latest_fields(fields: Sequence[str], seq: str) -> list[Column]:
    """Per field the last write as (s, v); such maxima fold again."""
    return [
        F.max(F.when(F.map_contains_key("changes", f),
                     F.struct(F.col(seq).alias("s"), F.col("changes")[f].alias("v")))).alias(f)
        for f in fields
    ]


def shown_fields(folded: DataFrame, fields: Sequence[str], key: str, at: str) -> DataFrame:
    return folded.select(key, *[F.col(f)["v"].alias(f) for f in fields], at)


def auto_approval(requests: DataFrame, memory: DataFrame, flags: DataFrame,
                  out_of_range: DataFrame) -> DataFrame:
    """Which requests could skip review, and the conditions one by one.

    ``requests`` carries headers and kpi_list of this run; ``memory`` the same for the last approved
    run of its client and template.
    """
    stored = memory.select(
        "client_id", "template_type", F.lit(True).alias("_stored"),
        F.array_sort(F.array_distinct("headers")).alias("_headers"),
        F.array_sort(F.array_distinct("kpi_list")).alias("_kpis"))
    counts = flags.select("request_id", "flag_count")
    outside = out_of_range.select("request_id", "out_of_range_count")

    def same(now: str, then: str):
        return F.coalesce(F.array_sort(F.array_distinct(now)) == F.col(then), F.lit(False))

    return (
        requests.join(stored, ["client_id", "template_type"], "left")
        .join(counts, "request_id", "left").join(outside, "request_id", "left")
        .select(
            "request_id", F.coalesce("_stored", F.lit(False)).alias("has_mapping"),
            same("headers", "_headers").alias("same_headers"),
            (F.coalesce("out_of_range_count", F.lit(0)) == 0).alias("in_range"),
            (F.coalesce("flag_count", F.lit(0)) == 0).alias("no_flags"),
            same("kpi_list", "_kpis").alias("same_kpis"),
        )
        .withColumn("auto_approved", F.col("has_mapping") & F.col("same_headers")
                    & F.col("in_range") & F.col("no_flags") & F.col("same_kpis"))
    )
