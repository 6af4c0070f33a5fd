"""How values are written in text: integers, doubles and no value, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for no value, in any case, after trimming.
NO_VALUE = ("", "null", "na", "n/a", "nan")
INTEGER = r"^[+-]?[0-9]+$"
DOUBLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: White space of every script, as trimmed from values.
SPACE = "\\s\\u001C-\\u001F\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def bigint_of(c: Column) -> Column:
    """The number if ``c`` is written as an integer that fits 64 bits, else null.

    Up to 18 digits are cast as they are.  More go through decimal(38,0), so that no sign, zero fill or overflow is
    guessed at; leading zeros are dropped first, as there may be any number of them.
    """
    digits = F.regexp_replace(F.regexp_replace(c, "^\\+", ""), "^(-?)0+(?=[0-9])", "$1")
    wide = F.when(c.rlike(INTEGER) & (F.length(digits) <= 20), digits).try_cast("decimal(38,0)")
    return F.when(c.rlike("^[+-]?[0-9]{1,18}$"), c.try_cast("bigint")).when(wide.between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)")), wide.cast("bigint"))


def double_of(c: Column) -> Column:
    """The number if ``c`` is written as a double, else null; words such as nan are none."""
    return F.when(c.rlike(DOUBLE), c).try_cast("double")


def is_value(c: Column) -> Column:
    """Of a trimmed text: true if it is a value at all."""
    return c.isNotNull() & ~F.lower(c).isin(*NO_VALUE)
