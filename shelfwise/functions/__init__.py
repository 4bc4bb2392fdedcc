"""Column functions: built-in expressions only, so they stay inside codegen."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits that an entry must keep.
MIN_DURATION, MAX_DURATION = 1, 1000
FIRST_CHOICE, LAST_CHOICE = 1, 5

# The blanks are spelt out: \s differs between regular-expression engines.
_LEADING_INT = r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)"
_BLANK = r"^[ \t\n\x0B\f\r]*$"


def parse_int(text: Column) -> Column:
    """Leading 32-bit integer of a text; null if there is none or it overflows."""
    return F.regexp_extract(text, _LEADING_INT, 1).try_cast("int")


def in_range(value: Column, low: int, high: int) -> Column:
    """Inclusive on both ends; false (not null) for a missing value."""
    return F.coalesce(value.between(low, high), F.lit(False))


def is_blank(text: Column) -> Column:
    """True for null, empty or white-space text: such input is skipped."""
    return text.isNull() | text.rlike(_BLANK)


def non_empty(text: Column) -> Column:
    """At least one character. Nothing is trimmed: a single space passes."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def record_line(title: Column, host: Column, duration: Column) -> Column:
    parts = (title, F.lit(" | Host: "), host, F.lit(" | Duration: "), duration.cast("string"), F.lit(" min"))
    return F.concat(*parts)


def listing_line(ordinal: Column, title: Column, host: Column, duration: Column) -> Column:
    return F.concat(ordinal.cast("string"), F.lit(". "), record_line(title, host, duration))


def found_line(title: Column, host: Column, duration: Column) -> Column:
    return F.concat(F.lit("Found: "), record_line(title, host, duration))
