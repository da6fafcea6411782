"""What counts as missing: three rules, each under its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_falsy(c: str | Column) -> Column:
    """Null, an empty text or zero."""
    return col(c).isNull() | col(c).cast("string").isin("", "0", "0.0")


def is_blank(c: str | Column) -> Column:
    """Null, or nothing but white space."""
    return col(c).isNull() | (F.trim(col(c).cast("string")) == "")


def is_blank_or_na(c: str | Column) -> Column:
    """Blank, or N/A in any case."""
    return is_blank(c) | (F.upper(F.trim(col(c).cast("string"))) == "N/A")


def filled(c: str | Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(col(c), F.lit(""))
