"""Global 1..N numbering without a global window over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.operators.dedup import surviving_ordinals

# Width of an ordinal block. File ordinals are byte positions (sources.files), so 2^27 is one
# 128 MB split; use fewer bits for dense ordinals.
BLOCK_BITS = 27


def number_rows(
    df: DataFrame,
    lead: Sequence[str] = ("source_file",),
    order: str = "ord",
    id_column: str = "review_id",
    block_bits: int = BLOCK_BITS,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add 1..N in (``lead``, ``order``, ``within``) order.

    Rows are numbered inside blocks of the ordinal range. Block sizes are summed in order in a
    window over the block table, which has one row per 128 MB of input, and the offsets join
    back on the block, a key the numbered rows are already partitioned by.
    """
    block = ["_block"] + [f"_lead{i}" for i in range(len(lead))]
    tagged = df.withColumn("_block", F.shiftright(F.col(order), block_bits))
    for i, column in enumerate(lead):
        tagged = tagged.withColumn(f"_lead{i}", F.col(column))
    sizes = tagged.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"))
    in_order = Window.orderBy(*block[1:], "_block")
    before = F.sum("_rows").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*block, F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*block).orderBy(order, *within))
    numbered = tagged.withColumn("_place", place).join(offsets, block)
    return numbered.withColumn(id_column, F.col("_before") + F.col("_place")).drop(
        *block, "_before", "_place"
    )


def renumber(
    df: DataFrame,
    lead: Sequence[str] = ("source_file",),
    order: str = "ord",
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Replace ``review_id`` by 1..N.

    Only (lead, ordinal) pairs go through the numbering; the full rows move once, in the join.
    """
    numbers = number_rows(df.select(*lead, order), lead, order, "review_id", block_bits)
    return df.drop("review_id").join(numbers.select(order, "review_id"), order)


def dedup_and_renumber(
    df: DataFrame,
    lead: Sequence[str] = ("source_file",),
    order: str = "ord",
    block_bits: int = BLOCK_BITS,
    null_text: str = "collapse",
    keys: DataFrame | None = None,
) -> DataFrame:
    """``dedup_reviews`` then ``renumber``, with one shuffle of the full rows.

    The surviving ordinals are numbered while they are narrow; one inner join on the ordinal
    then drops the duplicates and brings the number. ``keys`` as in ``dedup_reviews``.
    """
    survivors = surviving_ordinals(df if keys is None else keys, order, null_text=null_text)
    numbers = number_rows(survivors, lead, order, "review_id", block_bits)
    return df.drop("review_id").join(numbers.select(order, "review_id"), order)
