"""Numeric expressions: parsing, ratings, tips, spend."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.fixed import TIP_CAP

# What the reader accepts as a number. Java's parser also takes "1.0d", "1f" and
# hexadecimal forms, hence the guard before the cast.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = r"^(?i)[+-]?inf(inity)?$"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def null_nan(c: Column) -> Column:
    """NaN to null: Spark's max returns NaN if one is present."""
    return F.when(~F.isnan(c), c)


def coerce_numeric(c: Column) -> Column:
    """Text to double; what is not a number becomes null."""
    text = F.trim(c.cast("string"), F.lit(ASCII_SPACE))
    number = text.try_cast("double")
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    infinite = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(NUMBER), finite).when(text.rlike(INFINITE), infinite)


def scale_from_max(vmax: Column) -> Column:
    """Rating scale of a source, from its largest rating."""
    return (
        F.when((vmax > 5) & (vmax <= 10), 10)
        .when((vmax > 10) & (vmax <= 100), 100)
        .otherwise(5)
        .cast("int")
    )


def rating_1_5(raw: Column, scale: Column) -> Column:
    return raw / scale * F.lit(5.0)


def tip_fill(pct: Column, total: Column, amount: Column) -> Column:
    """Missing or zero tip share from amount and total; guarded, so no division by zero."""
    needed = (pct.isNull() | (pct == 0)) & (total > 0) & amount.isNotNull()
    return F.when(needed, amount / F.when(total > 0, total) * 100).otherwise(pct)


def tip_cap(pct: Column, cap: float = TIP_CAP) -> Column:
    """Not ``least``: it skips nulls and would turn a missing share into the cap."""
    return F.when(pct > cap, F.lit(cap)).otherwise(pct)


def log_spent(total: Column) -> Column:
    """ln(1 + max(total, 0)); null stays null, which bare ``greatest`` would lose."""
    return F.when(total.isNotNull(), F.log1p(F.greatest(total, F.lit(0.0))))


def round_even(c: Column, digits: int) -> Column:
    """Round half to even on the scaled double."""
    factor = 10.0**digits
    return F.rint(c * factor) / factor
