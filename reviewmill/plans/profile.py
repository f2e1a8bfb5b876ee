"""Exploration: column statistics, histograms, outliers, duplicate candidates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.text import mentions_any, norm_text_dupkey
from reviewmill.operators.dedup import digest
from reviewmill.operators.quantiles import ACCURACY, exact_quantiles, linear, sketches

NUMERIC = [
    "rating_raw", "rating_scale", "rating_1_5", "total_spent", "tip_amount", "tip_percentage",
    "party_size",
]
QUARTILES = [0.25, 0.5, 0.75]
TEXT_COLUMNS = ["customer_name", "review_text", "location", "restaurant_name"]


def describe(
    df: DataFrame, columns: Sequence[str] = NUMERIC, accuracy: int = ACCURACY
) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles, max; one row per column.

    Two passes whatever the number of columns: the first also sketches the quartiles, the second
    counts around them (``exact_quantiles``). No column is gathered in one task.
    """

    def facts(column: str):
        c = F.col(column).cast("double")
        return [
            F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"), F.max(c).alias("max"),
        ]

    spots = [linear(q) for q in QUARTILES]
    sketch = sketches(df, columns, spots, accuracy, facts)
    shown = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"s.c{i}.{name}").alias(name) for name in ("count", "mean", "std", "min", "max")])
        for i, c in enumerate(columns)
    ]
    one = df.sparkSession.range(1, numPartitions=1).select(sketch.scalar().alias("s"))
    cuts = exact_quantiles(df, columns, spots, accuracy, sketch).select(
        "column", *[F.get("values", F.lit(i)).alias(f"q{int(q * 100)}") for i, q in enumerate(QUARTILES)]
    )
    return one.select(F.inline(F.array(*shown))).join(cuts, "column", "left")


def scale_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source_file").agg(
        F.min("rating_scale").alias("min_scale"),
        F.max("rating_scale").alias("max_scale"),
        F.countDistinct("rating_scale").alias("n_scales"),
    )


def quantile_outliers(
    df: DataFrame, column: str = "total_spent", q: float = 0.99, accuracy: int = ACCURACY
) -> DataFrame:
    """Rows strictly above the exact quantile."""
    limit = exact_quantiles(df, [column], [linear(q)], accuracy).select(F.get("values", F.lit(0)))
    return df.filter(F.col(column) > limit.scalar())


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 25) -> DataFrame:
    """Equal-width bin counts per column; the last bin is closed.

    The bounds are one aggregation, looked up when the bins are counted. A column with a single
    value gets a range of half a unit to either side.
    """
    ends = [
        F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    bounds = df.agg(F.struct(*ends).alias("b"))
    cells = []
    for i, column in enumerate(columns):
        lo, hi = F.col(f"b.c{i}.lo"), F.col(f"b.c{i}.hi")
        lo, hi = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
        place = F.width_bucket(F.col(f"v{i}"), lo, hi, F.lit(bins))
        place = F.when(place > bins, F.lit(bins)).otherwise(place).cast("int")
        cells.append(F.struct(F.lit(column).alias("column"), place.alias("bin"), lo.alias("lo"), hi.alias("hi")))
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    long = rows.withColumn("b", bounds.scalar()).select(F.inline(F.array(*cells))).filter(F.col("bin").isNotNull())
    return long.groupBy("column", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def dup_candidates(df: DataFrame, limit: int = 10) -> DataFrame:
    """Largest groups of equal customer, normalized text, date and restaurant.

    Groups are counted by text digest; the text itself is fetched for the few shown groups.
    """
    text = norm_text_dupkey(F.col("review_text"))
    groups = df.groupBy(
        "customer_name", digest(text).alias("_text"), "review_date", "restaurant_name"
    ).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    top = groups.orderBy(F.desc("n"), "first_ord").limit(limit).drop("_text")
    texts = df.select(F.col("ord").alias("first_ord"), text.alias("text_norm"))
    # ``top`` has at most ``limit`` rows.
    return texts.join(F.broadcast(top), "first_ord")


def blank_counts(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """Missing or empty cells per text column."""
    counts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias("blank"),
        )
        for c in columns
    ]
    return df.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def with_wait_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("mentions_wait", mentions_any(F.col("review_text")))


def sum_flags(df: DataFrame) -> DataFrame:
    """Number of rows that mention waiting."""
    return df.agg(F.count_if(mentions_any(F.col("review_text"))).alias("rows_waiting"))


def sample_rows(df: DataFrame, n: int = 5, seed: int = 42, key: str = "ord") -> DataFrame:
    """A repeatable sample: the rows with the smallest seeded hash of the key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def preview_rows(df: DataFrame, n: int = 6, order: str = "ord") -> DataFrame:
    return df.orderBy(order).limit(n)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; a column missing on one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
