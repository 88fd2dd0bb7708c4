"""Lenient casts, guarded arithmetic, time parsing and value cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest magnitude a double may have and still cast to BIGINT without an overflow error.
_BIGINT_BOUND = 9.2e18

# Words read as numbers in text columns.
TRUE_WORDS = ("true", "yes", "y")
FALSE_WORDS = ("false", "no", "n")


def to_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_finite(c: Column) -> Column:
    """True for a non-null double that is neither NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _plain_number(value: Column | str) -> Column:
    """Double, or null for text that is no decimal number.

    The cast alone would also read Java literals such as ``1d``, ``2f`` and ``0x1p3``.  The
    type test folds to a constant, so numeric columns pay for the cast only.
    """
    c = to_col(value)
    java_literal = (F.typeof(c) == "string") & c.cast("string").rlike("[dDfFxX]")
    return F.when(java_literal, F.lit(None)).otherwise(c.try_cast("double"))


def lenient_double(value: Column | str, default: float | None = 0.0) -> Column:
    """Number from anything; blank, unreadable and non-finite become ``default``."""
    number = _plain_number(value)
    return F.when(is_finite(number), number).otherwise(F.lit(default).cast("double"))


def lenient_int(value: Column | str, default: int | None = 0) -> Column:
    """Whole number truncated towards zero, so ``'12.7'`` is 12; unreadable is ``default``."""
    number = _plain_number(value)
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(_BIGINT_BOUND))
    return F.when(usable, F.when(usable, number).cast("bigint")).otherwise(F.lit(default).cast("bigint"))


def safe_divide(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(default).cast("double"))


def parse_timestamp(value: Column | str) -> Column:
    """ISO-8601 text to an instant; text without a zone is UTC, bad text is null."""
    return F.try_to_timestamp(to_col(value).cast("string"))


def window_floor(ts: Column, minutes: int) -> Column:
    """Start of the epoch-aligned tumbling window that holds ``ts``."""
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(int(minutes) * 60)))


def iso_utc(ts: Column) -> Column:
    """Text form used at sinks; inside plans window keys stay timestamps."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def text_or(value: Column, default: str) -> Column:
    """Trimmed text, with null and blank replaced."""
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit(default))


def value_length(value: Column) -> Column:
    return F.coalesce(F.length(value.cast("string")), F.lit(0)).cast("bigint")


def numeric_or_null(value: Column | str) -> Column:
    """Double with null for text that is not a number."""
    return _plain_number(value)


def boolish_to_double(value: Column | str) -> Column:
    """Text to number, also reading yes/no words; everything else is 0."""
    word = F.lower(F.trim(to_col(value).cast("string")))
    number = _plain_number(word)
    return (
        F.when(is_finite(number), number)
        .when(number.isNotNull(), F.lit(0.0))
        .when(word.isin(*TRUE_WORDS), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def clean_double(value: Column) -> Column:
    """Null, NaN and infinities become 0."""
    return F.when(is_finite(value), value).otherwise(F.lit(0.0))


def cyclic_hour(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(0))


def weekday_monday0(ts: Column) -> Column:
    return F.coalesce(F.weekday(ts), F.lit(0))


def is_weekend(ts: Column) -> Column:
    return F.coalesce((F.weekday(ts) >= 5).cast("int"), F.lit(0))
