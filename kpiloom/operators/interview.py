"""Interview transcripts and the state of collected answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kpiloom.functions.text import transcript_line
from kpiloom.schemas import INTERVIEW_RESULT, INTERVIEW_STEPS, fields


def transcripts(messages: DataFrame, key: str = "conv_id", turn: str = "turn",
                turns_per_page: int = 1000) -> DataFrame:
    """Labelled lines of each conversation in turn order, one row per page of turns.

    A page covers a fixed span of turn numbers, so a conversation of any length is spread over
    many tasks and rows; its pages in order, joined by line breaks, are the whole transcript.
    """
    page = F.floor(F.col(turn) / turns_per_page)
    line = transcript_line(F.col("role"), F.col("text"))
    return (
        messages.groupBy(key, page.alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("line"))))
             .alias("lines"))
        .select(key, "page", F.array_join(F.transform("lines", lambda r: r["line"]), "\n")
                .alias("transcript"))
    )


def decode_answers(documents: DataFrame, column: str) -> DataFrame:
    """Typed answers of an extraction document; unreadable JSON gives all nulls.

    Each text is parsed once: the one-row generator keeps the parser from being copied into every
    filter and expression over the answers.
    """
    parsed = F.from_json(column, fields(INTERVIEW_RESULT))
    return documents.select("*", F.explode(F.array(parsed)).alias("answers"))


def progress(answers: Column) -> tuple[Column, Column, Column]:
    """Step number of the first open item, its label, and whether all items are there.

    Filters may be an empty list but must have been answered; the other lists must hold an item.
    """
    def some_text(name: str) -> Column:
        return F.coalesce(answers[name], F.lit("")) != ""

    def some_items(name: str) -> Column:
        return F.coalesce(F.size(answers[name]), F.lit(0)) > 0

    step = (
        F.when(~some_text("date_column"), 1).when(~some_items("kpis"), 2)
        .when(~some_items("dimensions"), 3).when(~some_text("granularity"), 4).otherwise(5)
    )
    label = F.get(F.array(*[F.lit(s) for s in INTERVIEW_STEPS]), step - 1)
    complete = (
        some_text("date_column") & some_items("kpis") & some_items("dimensions")
        & some_text("granularity") & answers["filters"].isNotNull()
    )
    return step, label, complete


def with_progress(documents: DataFrame, column: str, reply: str | None = None) -> DataFrame:
    """Step, label and completion per document; a reply carrying the marker completes too."""
    from kpiloom.functions.text import has_completion_marker

    decoded = decode_answers(documents, column)
    step, label, complete = progress(F.col("answers"))
    if reply is not None:
        complete = complete | has_completion_marker(F.col(reply))
    return decoded.withColumns({"step_index": step, "step_label": label, "completed": complete})
