"""Joins of reviews with other tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.fixed import METADATA_JOINED
from reviewmill.sizes import broadcast_if_small


def enrich_left_join(
    reviews: DataFrame, info: DataFrame, columns: Sequence[str] = METADATA_JOINED
) -> DataFrame:
    """Reviews with the metadata of their restaurant.

    Missing names match missing names, and two metadata rows for one name multiply the reviews.
    """
    lean = info.select(*columns).distinct()
    right = broadcast_if_small(
        lean.select(
            F.col(columns[0]).alias("_name"), *[F.col(c) for c in columns[1:]]
        )
    )
    joined = reviews.join(right, reviews[columns[0]].eqNullSafe(F.col("_name")), "left")
    return joined.drop("_name")


def conflicting_ids(df: DataFrame, by: Sequence[str] = ("customer_name",)) -> DataFrame:
    """Ids shared by more than one value of any ``by`` column.

    The distinct counts aggregate on (id, value) before they meet per id, so a hot id arrives
    already folded.
    """
    known = df.filter(F.col("review_id").isNotNull())
    conflicts = None
    for column in by:
        found = (
            known.groupBy("review_id")
            .agg(F.countDistinct(column).alias("n"))
            .filter(F.col("n") > 1)
            .select("review_id")
        )
        conflicts = found if conflicts is None else conflicts.union(found).distinct()
    return conflicts


def flag_conflicts(df: DataFrame, by: Sequence[str] = ("customer_name",)) -> DataFrame:
    """Rows whose id is shared by several customers."""
    return df.join(conflicting_ids(df, by), "review_id", "left_semi")
