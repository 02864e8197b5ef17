"""Number parsing, rounding and number-to-text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepline.functions.text import strip

# Decimal literals, optional exponent, and the spelled-out special values a CSV reader accepts.
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(col: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null.

    The pattern guard keeps Java-only spellings such as '1.0d' out of the cast.
    """
    text = strip(col)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def round_exact(col: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even.

    ``F.round`` works on the shortest decimal text (2.675 -> 2.68) where the stored value is
    below the tie. ``format_number`` rounds the stored value, so its text is parsed back.
    """
    return fixed_text(col, digits).cast("double")


def round_scaled(col: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: how array libraries round."""
    factor = float(10**digits)
    return F.rint(col * F.lit(factor)) / F.lit(factor)


def fixed_text(col: Column, digits: int) -> Column:
    """Text with a fixed number of decimals and no thousands separators."""
    return F.translate(F.format_number(col.cast("double"), digits), ",", "")


def percent_text(col: Column, digits: int = 0) -> Column:
    """A share in [0, 1] as percent text."""
    return F.concat(fixed_text(col * F.lit(100.0), digits), F.lit("%"))


def signed_text(col: Column, digits: int) -> Column:
    """Fixed-decimal text that always carries its sign."""
    return F.concat(F.when(col < 0, F.lit("")).otherwise(F.lit("+")), fixed_text(col, digits))


def safe_divide(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num/den, with ``default`` where the divisor is zero."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(
        F.lit(default).cast("double")
    )
