"""Word splitting as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that ends a word: blank, and the controls from tab to carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text: str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text column, in order."""
    inner = F.btrim(F.col(text), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
