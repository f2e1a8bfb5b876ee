"""Keep-first deduplication.

The first row per key is found on narrow rows: (source, 32-byte text digest, ordinal). Map-side
partial aggregation folds a hot key, such as the missing text that a third of all rows may
share, to one small row per task. Full rows move once, in the semi join on the ordinal, whose
values are unique and therefore never skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_KEY = ["review_text"]
COMPOSITE_KEY = ["customer_name", "review_text", "review_date", "restaurant_name"]


def digest(c: Column) -> Column:
    """32-byte stand-in for a long text key; null stays null."""
    return F.unhex(F.sha2(c, 256))


def drop_empty_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows that are null in every mapped column."""
    return df.dropna(how="all", subset=list(columns))


def first_ordinals(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "ord",
    within: Sequence[str] = ("source_file",),
    null_text: str = "collapse",
) -> DataFrame:
    """Smallest ordinal per key, as (``within``..., ``order``). Nulls are equal to each other.

    ``null_text='keep'`` makes each row with a missing text its own group.
    """
    group = [F.col(c).alias(f"w{i}") for i, c in enumerate(within)]
    for i, key in enumerate(keys):
        column = F.col(key)
        if key == "review_text":
            column = digest(column)
        group.append(column.alias(f"k{i}"))
    if null_text == "keep" and "review_text" in keys:
        group.append(F.when(F.col("review_text").isNull(), F.col(order)).alias("own"))
    firsts = df.groupBy(*group).agg(F.min(order).alias(order))
    return firsts.select(*[F.col(f"w{i}").alias(c) for i, c in enumerate(within)], order)


def keep_first(df: DataFrame, keys: Sequence[str], order: str = "ord", **options) -> DataFrame:
    """Rows of ``df`` that come first in their key group."""
    firsts = first_ordinals(df, [c for c in keys if c in df.columns], order, **options)
    return df.join(firsts.select(order), order, "left_semi")


def dedup_text(df: DataFrame, **options) -> DataFrame:
    return keep_first(df, TEXT_KEY, **options)


def dedup_key(df: DataFrame, **options) -> DataFrame:
    return keep_first(df, COMPOSITE_KEY, **options)


def surviving_ordinals(
    df: DataFrame,
    order: str = "ord",
    within: Sequence[str] = ("source_file",),
    null_text: str = "collapse",
) -> DataFrame:
    """Ordinals left after the text step and the composite step, in one aggregation.

    After the text step, texts are unique per source, so the composite key (which holds the
    text) can only drop rows among missing texts, and only if those were kept. Hence one
    grouping: by text, and for missing texts also by the other key columns.
    """
    if null_text == "collapse":
        return first_ordinals(df, TEXT_KEY, order, within)
    missing = F.col("review_text").isNull()
    group = [F.col(c) for c in within] + [digest(F.col("review_text")).alias("k0")]
    others = [c for c in COMPOSITE_KEY if c != "review_text" and c in df.columns]
    group += [F.when(missing, F.col(c)).alias(f"k{i}") for i, c in enumerate(others, 1)]
    return df.groupBy(*group).agg(F.min(order).alias(order)).select(*within, order)


def dedup_reviews(
    df: DataFrame, order: str = "ord", keys: DataFrame | None = None, **options
) -> DataFrame:
    """Text step, then composite step.

    ``keys`` are the same rows with other texts that are equal where those of ``df`` are, such as
    digests made at the scan: where ``df`` is a join, the texts then do not move to be compared.
    """
    firsts = surviving_ordinals(df if keys is None else keys, order, **options)
    return df.join(firsts.select(order), order, "left_semi")


def dedup_counts(
    df: DataFrame, mapped: Sequence[str], null_text: str = "collapse"
) -> DataFrame:
    """Rows per source before, after each step, and dropped in all.

    One narrow grouping tells how many rows a text has (or a missing text's other key columns, where
    missing texts are kept); each group leaves one row, and the groups are summed per source.
    """
    present = F.lit(False)
    for column in mapped:
        present = present | F.col(column).isNotNull()
    missing = F.col("review_text").isNull()
    keys = [digest(F.col("review_text")).alias("k0")]
    if null_text != "collapse":
        others = [c for c in COMPOSITE_KEY if c != "review_text" and c in df.columns]
        keys += [F.when(missing, F.col(c)).alias(f"k{i}") for i, c in enumerate(others, 1)]
    groups = df.groupBy("source_file", *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(present).alias("filled"))
    left = F.count_if(F.col("filled") > 0)
    lone = F.sum(F.when(F.col("k0").isNull(), F.col("filled") - (F.col("filled") > 0).cast("long")).otherwise(0))
    counts = groups.groupBy("source_file").agg(
        F.sum("n").alias("rows_before"), F.sum("filled").alias("rows_nonempty"),
        (left if null_text == "collapse" else left + lone).alias("rows_text"), left.alias("rows_key"),
    )
    return counts.withColumn("rows_dropped", F.col("rows_before") - F.col("rows_key"))
