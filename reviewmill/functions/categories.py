"""Category normalization and row keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.functions.text import coerce_str


def raw_category(c: Column) -> Column:
    return F.lower(coerce_str(c))


def map_category(c: Column, table: Mapping[str, str]) -> Column:
    """Normal form of a category value; an unknown value stays as it is."""
    branches = F
    for raw, norm in table.items():
        branches = branches.when(c == raw, F.lit(norm))
    return F.coalesce(branches, c)


def is_unmapped(c: Column, table: Mapping[str, str]) -> Column:
    """True for a present value that the table does not know."""
    return c.isNotNull() & ~c.isin(*table)


def row_key(restaurant: Column, date: Column, *identity: Column) -> Column:
    """``restaurant_date_`` and 8 hex digits.

    The digits come from the row itself. Random ones would change when a lost task reruns.
    """
    day = F.coalesce(F.date_format(date, "yyyy-MM-dd HH:mm:ss"), F.lit("NA"))
    seed = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in identity])
    return F.concat_ws(
        "_", F.coalesce(restaurant, F.lit("NA")), day, F.substring(F.sha2(seed, 256), 1, 8)
    )
