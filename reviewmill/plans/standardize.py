"""Mapped text columns to the standard review schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.fixed import (
    CATEGORIES,
    EXTENDED_COLUMNS,
    NORM_COLUMNS,
    STANDARD_COLUMNS,
    TEXT_LIMIT,
    TIP_CAP,
)
from reviewmill.functions import categories, dates, numbers, text
from reviewmill.sizes import broadcast_if_small

AMOUNTS = ["total_spent", "tip_amount", "tip_percentage", "party_size"]
LABELS = ["customer_name", "location", "restaurant_name"]
MAPPED = [
    name
    for name, _ in STANDARD_COLUMNS
    if name not in ("rating_scale", "rating_1_5", "source_file")
]


def fill_missing_columns(df: DataFrame) -> DataFrame:
    """Add absent target columns as typed nulls."""
    absent = {
        name: F.lit(None).cast(kind)
        for name, kind in STANDARD_COLUMNS + NORM_COLUMNS
        if name not in df.columns
    }
    return df.withColumns(absent) if absent else df


def coerce_types(
    mapped: DataFrame,
    layouts: Sequence[str] = dates.DEFAULT_LAYOUTS,
    date_mode: str = "source",
    blank_to_null: bool = False,
    fill_text: str | None = None,
) -> DataFrame:
    """Text cells to typed columns; what does not parse becomes null.

    ``date_mode``: 'source' reads day and month in the order of the row's source, if the rows
    carry it (``apply_facts``; a stream cannot), 'lenient' takes the first layout that fits the
    cell, 'strict' one layout per source, that of its first cell.
    """
    have = set(mapped.columns)
    typed = {}
    for name in LABELS:
        if name in have:
            label = text.coerce_str(F.col(name).cast("string"))
            typed[name] = F.nullif(label, F.lit("")) if blank_to_null else label
    if "review_text" in have:
        typed["review_text"] = text.clean_text(F.col("review_text").cast("string"), fill_text)
    if "review_date" in have:
        if date_mode == "strict":
            mapped = _with_source_layout(mapped, layouts)
            typed["review_date"] = dates.coerce_date_as(
                F.col("review_date"), F.col("_layout"), layouts
            )
        elif dict(mapped.dtypes)["review_date"].startswith("timestamp"):
            typed["review_date"] = F.col("review_date").cast("timestamp_ntz")
        else:
            ordered = date_mode == "source" and "_day_first" in have
            day_first = F.col("_day_first") if ordered else None
            typed["review_date"] = dates.coerce_date(F.col("review_date"), layouts, day_first)
    for name in ["rating_raw", *AMOUNTS]:
        if name in have:
            typed[name] = _number(mapped, name)
    for raw in CATEGORIES:
        if raw in have:
            typed[raw] = categories.raw_category(F.col(raw).cast("string"))
    return mapped.withColumns(typed).drop("_layout", "_day_first")


def _number(mapped: DataFrame, name: str) -> Column:
    if dict(mapped.dtypes)[name] == "string":
        return numbers.coerce_numeric(F.col(name))
    return numbers.null_nan(F.col(name).cast("double"))


def _with_source_layout(mapped: DataFrame, layouts: Sequence[str]) -> DataFrame:
    """Strict dates: the first present value of a source picks its one layout.

    Found as the layout with the smallest ordinal, so the aggregation buffer is one long.
    """
    seen = mapped.select(
        "source_file", "ord", dates.layout_index(F.col("review_date"), layouts).alias("_layout")
    ).filter(F.col("_layout").isNotNull())
    firsts = seen.groupBy("source_file", "_layout").agg(F.min("ord").alias("_first"))
    chosen = firsts.groupBy("source_file").agg(F.min_by("_layout", "_first").alias("_layout"))
    return mapped.join(broadcast_if_small(chosen), "source_file", "left")


def rating_scales(typed: DataFrame) -> DataFrame:
    """Rating scale per source, from the largest parsed rating (5 when none parsed).

    A source whose file has no rating column gets a null scale: the scan marks it with
    ``has_rating`` false.
    """
    return typed.groupBy("source_file").agg(_scale(typed))


def _scale(df: DataFrame) -> Column:
    scale = numbers.scale_from_max(F.max(_number(df, "rating_raw")))
    if "has_rating" in df.columns:
        scale = F.when(F.max("has_rating"), scale)
    return scale.alias("rating_scale")


def source_facts(
    mapped: DataFrame, date_mode: str = "source", scale: bool = True
) -> DataFrame | None:
    """What all cells of a source decide together, in one aggregation over the mapped text.

    ``rating_scale``, and ``_day_first``: whether more of its dates can only be read with the
    day first than with the month first. A source without such dates is month-first.
    """
    kinds, facts = dict(mapped.dtypes), []
    if scale and "rating_raw" in kinds:
        facts.append(_scale(mapped))
    if date_mode == "source" and kinds.get("review_date") == "string":
        votes = F.sum(dates.day_first_vote(F.col("review_date")))
        facts.append((votes > 0).alias("_day_first"))
    return mapped.groupBy("source_file").agg(*facts) if facts else None


def apply_facts(mapped: DataFrame, facts: DataFrame | None) -> DataFrame:
    """The facts of its source beside each row. One row per source."""
    return mapped if facts is None else mapped.join(broadcast_if_small(facts), "source_file", "left")


def apply_scales(typed: DataFrame, scales: DataFrame) -> DataFrame:
    """Per-source scale joined to the rows. The scale table has one row per source."""
    return typed.join(broadcast_if_small(scales), "source_file", "left")


def derive(scaled: DataFrame, cap: float = TIP_CAP) -> DataFrame:
    """Ratings, tips and category norms from typed columns."""
    full = fill_missing_columns(scaled)
    share = numbers.tip_fill(F.col("tip_percentage"), F.col("total_spent"), F.col("tip_amount"))
    derived = {
        "rating_1_5": numbers.rating_1_5(F.col("rating_raw"), F.col("rating_scale")),
        "tip_percentage": numbers.tip_cap(share, cap),
    }
    for raw, (norm, table) in CATEGORIES.items():
        derived[norm] = categories.map_category(F.col(raw), table)
    return full.withColumns(derived)


def extend(df: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """The optional columns: log spend, text length, cut text, row key."""
    return df.withColumns(
        {
            "log_total_spent": numbers.log_spent(F.col("total_spent")),
            "review_length": text.text_length(F.col("review_text")),
            "review_text_trunc": text.text_trunc(F.col("review_text"), limit),
            "unique_id": categories.row_key(
                F.col("restaurant_name"), F.col("review_date"), F.col("source_file"), F.col("ord")
            ),
        }
    )


def final_projection(df: DataFrame, extended: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Standard columns, then norms, cast to the target types.

    Columns that already have their type are passed by name. A plain rename of each column
    would double the optimizer's constraints once per column, for a filter that spans them all.
    """
    kinds = dict(df.dtypes)
    columns = [
        F.col(name) if kinds[name] == kind else F.col(name).cast(kind).alias(name)
        for name, kind in STANDARD_COLUMNS + NORM_COLUMNS
    ]
    return df.select(*columns, *(EXTENDED_COLUMNS if extended else []), *keep)


def standardize(
    mapped: DataFrame,
    extended: bool = False,
    scales: DataFrame | None = None,
    **coercion,
) -> DataFrame:
    """Full per-row plan, before deduplication. Needs ``source_file`` and ``ord``.

    ``scales`` (source_file, rating_scale) replaces the scale found in the data. Empty rows are
    dropped by the scan (sources.files).
    """
    facts = source_facts(mapped, coercion.get("date_mode", "source"), scale=scales is None)
    typed = coerce_types(apply_facts(mapped, facts), **coercion)
    if scales is not None:
        typed = apply_scales(typed, scales)
    ready = derive(typed)
    if extended:
        ready = extend(ready)
    return final_projection(ready, extended, keep=["ord"])
