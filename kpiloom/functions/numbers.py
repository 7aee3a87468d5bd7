"""Sums, ratios and number text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

_FLOATING = (T.FloatType, T.DoubleType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Exact sums: a value is cut into whole units in three steps of 20 bits, millionths, and what is left below
# a millionth. The first four are long sums, the same for any order of the rows; the rest, and doubles whose
# units no long holds, are sums of doubles.
UNIT_BITS = 20
EXACT_PARTS = ("high", "mid", "low", "micro", "rest", "large")
_LONG_UNITS = 2.0**62


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def present(column: Column, dtype: T.DataType) -> Column:
    """The value, with NaN read as missing."""
    if isinstance(dtype, _FLOATING):
        return F.when(~F.isnan(column), column)
    return column


def exact_parts(value: Column, dtype: T.DataType) -> dict[str, Column]:
    """Sums that add up over any grouping of the rows, by name of the part; longs keep every digit."""
    integral = isinstance(dtype, _INTEGRAL)
    if integral:
        whole = value.cast("bigint")
    else:
        value = value.cast("double")
        fits = F.abs(value) < _LONG_UNITS
        whole = F.floor(F.when(fits, value))
    zero, mask = F.lit(0).cast("bigint"), F.lit((1 << UNIT_BITS) - 1)
    parts = {
        "high": F.coalesce(F.sum(F.shiftright(whole, 2 * UNIT_BITS)), zero),
        "mid": F.coalesce(F.sum(F.shiftright(whole, UNIT_BITS).bitwiseAND(mask)), zero),
        "low": F.coalesce(F.sum(whole.bitwiseAND(mask)), zero),
    }
    if integral:
        return parts | {"micro": zero, "rest": F.lit(0.0), "large": F.lit(0.0)}
    fraction = value - whole
    micro = F.floor(fraction * 1_000_000 + F.lit(0.5))
    return parts | {
        "micro": F.coalesce(F.sum(micro), zero),
        "rest": F.coalesce(F.sum(fraction - micro / 1_000_000), F.lit(0.0)),
        "large": F.coalesce(F.sum(F.when(~fits, value)), F.lit(0.0)),
    }


def exact_value(parts: dict[str, Column]) -> Column:
    """The double behind summed parts."""
    def scaled(name: str, factor: Decimal) -> Column:
        return parts[name].cast("decimal(19,0)") * F.lit(factor)

    units = scaled("high", Decimal(1 << 2 * UNIT_BITS)) + scaled("mid", Decimal(1 << UNIT_BITS))
    below = parts["low"].cast("decimal(19,0)") + scaled("micro", Decimal("0.000001"))
    return (units + below).cast("double") + parts["rest"] + parts["large"]


def total(column: Column, dtype: T.DataType, exact: bool = True) -> Column:
    """Null-skipping sum, 0.0 when nothing is there.

    A plain double sum depends on the order in which partitions merge. ``exact`` adds whole
    units and millionths as long sums, so the result does not depend on partitioning and the
    aggregate keeps long buffers inside generated code; no digit is dropped.
    """
    column = present(column, dtype)
    if isinstance(dtype, T.BooleanType):
        column, dtype = column.cast("int"), T.IntegerType()
    if isinstance(dtype, T.DecimalType) or not exact:
        result = F.sum(column).cast("double")
    else:
        return exact_value(exact_parts(column, dtype))
    return F.coalesce(result, F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio of two totals, null for a zero denominator."""
    return F.when(denominator != 0, F.try_divide(numerator, denominator))


def round_kpi(value: Column) -> Column:
    return F.round(value, 4)


def plain_number(value: Column) -> Column:
    """Shortest text of a bound as a JSON document writes it: ``0``, ``0.5``, ``1000``."""
    return F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")


def formatted(value: Column, kind: Column, mixed_kind: Column | None = None) -> Column:
    """Display text of a KPI value; durations are taken as seconds.

    ``mixed`` charts show every KPI in its own format, given by ``mixed_kind``.
    """
    if mixed_kind is not None:
        kind = F.when(kind == "mixed", mixed_kind).otherwise(kind)
    seconds = F.floor(F.abs(value) + F.lit(0.5)).cast("bigint")
    clock = F.concat(
        F.when(value < 0, "-").otherwise(""),
        F.lpad(F.floor(seconds / 3600).cast("string"), 2, "0"), F.lit(":"),
        F.lpad(F.floor((seconds % 3600) / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((seconds % 60).cast("string"), 2, "0"),
    )
    return (
        F.when(value.isNull(), None)
        .when(kind == "percentage", F.concat(F.format_number(value * 100, 2), F.lit("%")))
        .when(kind == "integer", F.format_number(F.round(value, 0), 0))
        .when(kind == "currency", F.concat(F.lit("$"), F.format_number(value, 2)))
        .when(kind == "duration", clock)
        .otherwise(value.cast("string"))
    )
