"""Text tests and number formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Regular expressions in Java syntax.
EDGE_SPACE = r"(?U)^\s|\s$"
EDGE_SPACES = r"(?U)^\s+|\s+$"
NUMERIC_TEXT = (
    r"(?i)^[+-]?(\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)(e[+-]?\d(_?\d)*)?$"
    r"|^[+-]?(inf|infinity|nan)$"
)


def has_edge_space(text: Column) -> Column:
    """Leading or trailing white space of any Unicode kind."""
    return text.rlike(EDGE_SPACE)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACES, "")


def looks_numeric(text: Column) -> Column:
    """The text reads as a decimal, scientific, infinite or nan number."""
    return strip(text).rlike(NUMERIC_TEXT)


def grouped(value: Column, digits: int = 0) -> Column:
    """``1,234.5``: thousands separators, ties to even."""
    return F.format_number(value, digits)


def fixed(value: Column, digits: int) -> Column:
    """``1234.5``: fixed digits, ties to even."""
    return F.replace(F.format_number(value, digits), F.lit(","))


def percent(share: Column, digits: int) -> Column:
    """A share of one as ``12.34%``."""
    return F.concat(fixed(share * 100, digits), F.lit("%"))


def signed(value: Column) -> Column:
    """``+1,234`` or ``-1,234``."""
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("+")), grouped(F.abs(value)))


def first_names(names: Column, shown: int = 3) -> Column:
    """The first few names joined by commas, with dots when more follow."""
    return F.concat(
        F.concat_ws(", ", F.slice(names, 1, shown)),
        F.when(F.size(names) > shown, F.lit("...")).otherwise(F.lit("")),
    )
