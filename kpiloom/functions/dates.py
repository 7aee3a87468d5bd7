"""Report grains and the closed list of date formats the profiler accepts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Grain names of a report recipe and their calendar units (weeks start Monday).
GRAINS = {"daily": "day", "weekly": "week", "monthly": "month"}

# Formats tried by the profiler. One format must fit a whole column; times of
# day alone and words such as "today" are not dates here.
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "dd-MM-yyyy",
    "dd MMM yyyy",
    "yyyyMMdd",
    "M/d/yyyy",
    "d/M/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy h:mm a",
    "M/d/yyyy h:mm:ss a",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "dd-MMM-yyyy",
    "MMM d, yyyy",
]

# The longest text that fits one of the formats: an offset is three letters of a format but six characters.
LONGEST_DATE = max(len(f) for f in DATE_FORMATS) + 3

# Words in a column name that hint at a date. `_` is a word character, so
# `order_date` carries no hint while a bare `date` does.
DATE_NAME_HINT = (
    r"(?i)\b(date|day|week|month|year|time|dt|created|updated|timestamp|period)\b"
)


def grain(column: Column, granularity: str) -> Column:
    """Start of the day, week or month as wall-clock time."""
    return F.date_trunc(GRAINS[granularity], column).cast("timestamp_ntz")


def parses(value: Column, pattern: str) -> Column:
    """True where the text is a date in exactly this format.

    White space around it does not count. Texts that are too long for every format or hold no digit
    are ruled out before the parser sees them.
    """
    value = F.trim(value)
    possible = (F.length(value) <= LONGEST_DATE) & value.rlike("[0-9]")
    return F.when(possible, F.try_to_timestamp(value, F.lit(pattern)).isNotNull()).otherwise(False)
