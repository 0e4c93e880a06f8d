"""Key forms and readable values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the patterns of readable numbers (sign and digits; sign, digits, fraction, exponent) and dates.
INTEGER = r"^[+-]?[0-9]+\z"
DOUBLE = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
#: The spellings of the two truth values.
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")


def key_form(column: str | Column) -> Column:
    """Blanks (U+0020) trimmed at both ends, upper case; null where nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    trimmed = F.upper(F.trim(c))
    return F.when(trimmed != "", trimmed)


def plain_name(column: str | Column) -> Column:
    """Lower case, and only the letters a-z and the digits 0-9."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def as_integer(value: Column) -> Column:
    """The value as a long within 32 bits, null where it isn't readable."""
    number = F.when(value.rlike(INTEGER), value).try_cast("bigint")
    return F.when(number.between(-(2**31), 2**31 - 1), number)


def as_double(value: Column) -> Column:
    """The value as a double, null where it isn't readable."""
    return F.when(value.rlike(DOUBLE), value).try_cast("double")


def as_boolean(value: Column) -> Column:
    """1 or 0 as a long, null where the value isn't readable."""
    word = F.lower(value)
    return F.when(word.isin(*TRUE_WORDS), F.lit(1)).when(word.isin(*FALSE_WORDS), F.lit(0)).cast("bigint")


def as_date_text(value: Column) -> Column:
    """The value itself if it is a calendar day from year 1 on, else null."""
    return F.when(
        value.rlike(DATE) & ~value.startswith("0000") & F.when(value.rlike(DATE), value).try_cast("date").isNotNull(), value
    )
