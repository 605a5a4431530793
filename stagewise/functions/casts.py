"""Text to number and boolean, with the spellings the plans accept and no others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of numbers and booleans in text inputs.
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DIGITS = r"^[+-]?\d+$"
TRUE_TEXT = ["1", "t", "T", "TRUE", "true", "True"]
FALSE_TEXT = ["0", "f", "F", "FALSE", "false", "False"]

# Up to here a DOUBLE tells all integers apart.
EXACT_DOUBLE = 2**53


def text_to_number(text: Column) -> Column:
    """DOUBLE of a plainly written number, else null; Spark's cast alone also takes blanks and type suffixes."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def text_to_integer(text: Column) -> Column:
    """BIGINT of a number without fraction, else null.

    Plain digits are read as they stand; other spellings go through DOUBLE and count only where it holds every integer.
    """
    number = text_to_number(text)
    spelled = F.when((number == F.floor(number)) & (F.abs(number) <= EXACT_DOUBLE), number.try_cast("bigint"))
    return F.when(text.rlike(DIGITS), text.try_cast("bigint")).otherwise(spelled)


def text_to_boolean(text: Column) -> Column:
    """BOOLEAN of one of the accepted spellings, else null."""
    return F.when(text.isin(TRUE_TEXT), F.lit(True)).when(text.isin(FALSE_TEXT), F.lit(False))
