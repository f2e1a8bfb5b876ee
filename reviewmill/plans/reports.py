"""Integrity, validation and representation reports, as long-form frames.

Each report is one or two aggregations. Distinct counts fold per (group, value) before they
meet per group, so a source with a third of all rows does not gather in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.fixed import (
    AGE_MISSING_WARN,
    CATEGORIES,
    METADATA_REQUIRED,
    REVIEW_REQUIRED,
    TEXT_LIMIT,
    TEXT_MISSING_FAIL,
    TEXT_MISSING_WARN,
    TIP_CAP,
)
from reviewmill.functions.categories import is_unmapped
from reviewmill.functions.numbers import round_even
from reviewmill.functions.text import fmt_pct, null_key_label

BIAS_COLUMNS = ["gender_norm", "age_group", "ethnicity_norm"]

RANGE_CHECKS = {
    "invalid_ratings": lambda: (F.col("rating_1_5") < 1) | (F.col("rating_1_5") > 5),
    "extreme_tips": lambda: F.col("tip_percentage") > TIP_CAP,
    "long_reviews": lambda: F.col("review_length") > TEXT_LIMIT,
}


def _by(df: DataFrame, group: Sequence[str]):
    return df.groupBy(*group)


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name="column", value="value"):
    """Wide to long, one output row per column."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns]
    )
    return df.select(*keys, F.inline(pairs))


# --- integrity ---------------------------------------------------------------


def integrity_totals(df: DataFrame, group: Sequence[str] = ("source_file",)) -> DataFrame:
    """Rows, distinct ids, duplicates (missing ids count) and distinct customers."""
    totals = [F.count(F.lit(1)).alias("total_rows")]
    if "review_id" in df.columns:
        ids = F.countDistinct("review_id")
        totals += [ids.alias("unique_reviews"), (F.count(F.lit(1)) - ids).alias("duplicate_reviews")]
    if "customer_name" in df.columns:
        totals.append(F.countDistinct("customer_name").alias("unique_customers"))
    return _by(df, group).agg(*totals)


def missing_fractions(
    df: DataFrame, columns: Sequence[str] | None = None, group: Sequence[str] = ("source_file",)
) -> DataFrame:
    """Null share of every column per group, long form."""
    columns = [c for c in (columns or df.columns) if c not in group]
    shares = [F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in columns]
    return unpivot(_by(df, group).agg(*shares), group, columns, "column", "missing")


def missingness(
    df: DataFrame, columns: Sequence[str] | None = None, group: Sequence[str] = ("source_file",)
) -> DataFrame:
    """Columns with missing values, the emptiest first, with the display text."""
    found = missing_fractions(df, columns, group).filter(F.col("missing") > 0)
    shown = found.withColumn("missing_text", fmt_pct(F.col("missing")))
    return shown.orderBy(*group, F.desc("missing"), "column")


def by_restaurant(df: DataFrame, group: Sequence[str] = ("source_file",)) -> DataFrame:
    """Per restaurant: present ids, distinct customers and share of the group's rows.

    The share is of all rows, with and without a restaurant name.
    """
    counts = _by(df, [*group, "restaurant_name"]).agg(
        F.count("review_id").alias("reviews"),
        F.countDistinct("customer_name").alias("unique_customers"),
        F.count(F.lit(1)).alias("_rows"),
    )
    totals = counts.groupBy(*group).agg(F.sum("_rows").alias("_total"))
    share = round_even(F.col("reviews") / F.col("_total") * 100, 2)
    counted = counts.join(totals, list(group)).withColumn("reviews_pct", share)
    return counted.drop("_rows", "_total").filter(F.col("restaurant_name").isNotNull())


# --- validation --------------------------------------------------------------


def missing_columns(df: DataFrame, required: Sequence[str] = REVIEW_REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def required_columns(
    df: DataFrame, required: Sequence[str] = REVIEW_REQUIRED, source: str = "source_file"
) -> DataFrame:
    """Required columns per source that the table lacks or that hold no value there."""
    absent = missing_columns(df, required)
    counts = [F.lit(0).alias(c) if c in absent else F.count(c).alias(c) for c in required]
    found = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    long = unpivot(found, ["source", "n_rows"], list(required), "missing_column", "present")
    return long.filter("present = 0").drop("present")


def repeats(column: str) -> Column:
    """Occurrences after the first, missing included."""
    missing = F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))
    return F.count(F.lit(1)) - F.countDistinct(column) - missing


def duplicate_ids(df: DataFrame, group: Sequence[str] = ("source_file",)) -> DataFrame:
    return _by(df, group).agg(repeats("review_id").alias("duplicate_ids"))


def row_count_mismatch(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows per source before and after, and the difference."""
    before = raw.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count_raw"))
    after = processed.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count_processed"))
    joined = before.join(after, "source_file", "left").na.fill(0, ["row_count_processed"])
    return joined.withColumn(
        "row_count_mismatch", F.col("row_count_raw") - F.col("row_count_processed")
    )


def range_checks(df: DataFrame, group: Sequence[str] = ("source_file",)) -> DataFrame:
    """Out-of-range rows per check; the length check needs the extended columns."""
    checks = [
        F.count_if(rule()).alias(name)
        for name, rule in RANGE_CHECKS.items()
        if name != "long_reviews" or "review_length" in df.columns
    ]
    return _by(df, group).agg(*checks)


def missing_thresholds(df: DataFrame, group: Sequence[str] = ("source_file",)) -> DataFrame:
    """Watched columns: missing share, whether to mention it, whether it passes the limit."""
    limits = {"review_text": TEXT_MISSING_WARN, "age_range": AGE_MISSING_WARN}
    shares = missing_fractions(df, list(limits), group)
    limit = reduce(
        lambda rest, c: F.when(F.col("column") == c, F.lit(limits[c])).otherwise(rest),
        limits,
        F.lit(None).cast("double"),
    )
    return shares.withColumns(
        {
            "mentioned": F.col("missing") > 0,
            "over_limit": F.col("missing") > limit,
            "missing_text": fmt_pct(F.col("missing")),
        }
    )


def null_text_fail(df: DataFrame, group: Sequence[str] = ("source_file",)) -> DataFrame:
    share = F.avg(F.col("review_text").isNull().cast("int"))
    return _by(df, group).agg(
        share.alias("null_review_text"), (share > TEXT_MISSING_FAIL).alias("failed")
    )


def unmapped_categories(df: DataFrame, group: Sequence[str] = ("source_file",)) -> DataFrame:
    """Distinct category values per source that have no normal form.

    ``parity`` marks values whose norm is null, which cannot happen while unknown values stand
    for themselves; the other rows are values outside the lookup table.
    """
    rows = [
        F.struct(
            F.lit(raw).alias("column"),
            F.col(raw).alias("value"),
            is_unmapped(F.col(raw), table).alias("unknown"),
            (F.col(norm).isNull() & F.col(raw).isNotNull()).alias("parity"),
        )
        for raw, (norm, table) in CATEGORIES.items()
    ]
    long = df.select(*group, F.inline(F.array(*rows)))
    return long.filter(F.col("unknown") | F.col("parity")).distinct().drop("unknown")


def validation_checks(processed: DataFrame, raw: DataFrame) -> DataFrame:
    """All numbers the status of a source needs, one row per source."""
    has_length = "review_length" in processed.columns
    facts = processed.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("row_count_processed"),
        repeats("review_id").alias("duplicate_ids"),
        F.count_if(RANGE_CHECKS["invalid_ratings"]()).alias("invalid_ratings"),
        F.count_if(RANGE_CHECKS["extreme_tips"]()).alias("extreme_tips"),
        (
            F.count_if(RANGE_CHECKS["long_reviews"]()) if has_length else F.lit(0).cast("long")
        ).alias("long_reviews"),
        F.avg(F.col("review_text").isNull().cast("int")).alias("null_text"),
        F.avg(F.col("age_range").isNull().cast("int")).alias("null_age"),
        F.count_if(
            reduce(
                Column.__or__,
                [F.col(n).isNull() & F.col(r).isNotNull() for r, (n, _) in CATEGORIES.items()],
            )
        ).alias("unmapped_rows"),
    )
    counts = raw.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count_raw"))
    filled = counts.join(facts, "source_file", "left").join(
        conflicts_per_source(raw), "source_file", "left"
    )
    numbers = [c for c in filled.columns if c != "source_file"]
    return filled.na.fill(0, numbers).withColumn(
        "row_count_mismatch", F.col("row_count_raw") - F.col("row_count_processed")
    )


def conflicts_per_source(raw: DataFrame) -> DataFrame:
    """Ids shared by several customers, counted per source; rows without an id are left out."""
    per_id = (
        raw.filter(F.col("review_id").isNotNull())
        .groupBy("source_file", "review_id")
        .agg(F.countDistinct("customer_name").alias("customers"))
    )
    return per_id.groupBy("source_file").agg(
        F.count_if(F.col("customers") > 1).alias("conflicting_ids")
    )


def dedup_metrics(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows dropped and conflicting ids per source."""
    counts = row_count_mismatch(raw, processed).select(
        "source_file", F.col("row_count_mismatch").alias("rows_dropped_dedup")
    )
    joined = counts.join(conflicts_per_source(raw), "source_file", "left")
    return joined.na.fill(0, ["conflicting_ids"])


def source_status(checks: DataFrame, missing_required: bool = False) -> DataFrame:
    """fail beats warn beats pass.

    A warning is set only while the status still passes, so the order of the checks is
    immaterial.
    """
    fails = (
        F.lit(missing_required)
        | (F.col("duplicate_ids") > 0)
        | (F.col("row_count_mismatch") != 0)
        | (F.col("invalid_ratings") > 0)
        | (F.col("extreme_tips") > 0)
        | (F.col("long_reviews") > 0)
        | (F.col("null_text") > TEXT_MISSING_FAIL)
    )
    warns = (
        (F.col("null_text") > TEXT_MISSING_WARN)
        | (F.col("null_age") > AGE_MISSING_WARN)
        | (F.col("unmapped_rows") > 0)
        | (F.col("conflicting_ids") > 0)
    )
    return checks.withColumn(
        "status", F.when(fails, "fail").when(warns, "warn").otherwise("pass")
    )


def validate_metadata(info: DataFrame, source: str) -> DataFrame:
    """Checks of the restaurant table, one row. Missing numbers pass, as they compare to null."""
    absent = missing_columns(info, METADATA_REQUIRED)

    def bad(column: str, rule) -> Column:
        return F.count_if(rule(F.col(column))) if column in info.columns else F.lit(0).cast("long")

    checked = info.agg(
        F.count(F.lit(1)).alias("row_count"),
        bad("avg_stars", lambda c: (c < 1) | (c > 5)).alias("invalid_avg_stars"),
        bad("total_reviews", lambda c: c < 0).alias("invalid_total_reviews"),
    )
    failed = (
        F.lit(bool(absent))
        | (F.col("invalid_avg_stars") > 0)
        | (F.col("invalid_total_reviews") > 0)
    )
    return checked.select(
        F.lit(source).alias("source"),
        "row_count",
        F.lit(len(absent)).cast("long").alias("missing_columns"),
        "invalid_avg_stars",
        "invalid_total_reviews",
        F.when(failed, "fail").otherwise("pass").alias("status"),
    )


def combined_status(
    statuses: DataFrame, metadata: DataFrame | None = None, run_id: str = "", at: str = ""
) -> DataFrame:
    """Worst status over the sources; metadata can only raise a failure.

    The run id and the time are given, so that a rerun writes the same report.
    """
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    ranks = statuses.select(rank.alias("rank"), F.lit(1).alias("review_source"))
    if metadata is not None:
        failing = F.when(F.col("status") == "fail", 2).otherwise(0)
        ranks = ranks.unionByName(
            metadata.select(failing.alias("rank"), F.lit(0).alias("review_source"))
        )
    worst = F.coalesce(F.max("rank"), F.lit(0))
    return ranks.agg(
        F.lit(run_id).alias("validation_id"),
        F.lit(at).alias("timestamp"),
        F.count(F.lit(1)).alias("sources"),
        F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass").alias("status"),
    )


def validation_document(
    statuses: DataFrame, raw: DataFrame, processed: DataFrame, metadata: DataFrame | None = None,
    run_id: str = "", at: str = "", required: Sequence[str] = REVIEW_REQUIRED,
) -> DataFrame:
    """One row per source: its status and the run's, checks, warnings, raw and processed integrity.

    ``statuses`` is the result of ``source_status``, ``metadata`` of ``validate_metadata``. Warnings
    hold the share of missing cells per watched column and the number of distinct unmapped values
    per category (``unmapped_categories`` lists them). A source without processed rows has null
    for what is counted on these.
    """
    by = ["source_file"]
    shares = missing_thresholds(processed).filter("mentioned").groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("column", "missing", "over_limit"))).alias("missing")
    )
    unmapped = unmapped_categories(processed).groupBy(*by, "column").agg(F.count("value").alias("n_values"))
    unmapped = unmapped.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("column", "n_values"))).alias("unmapped")
    )
    lacking = required_columns(processed, required).groupBy(F.col("source").alias("source_file")).agg(
        F.array_sort(F.collect_list("missing_column")).alias("missing_columns")
    )

    def integrity(df: DataFrame, name: str) -> DataFrame:
        found = integrity_totals(df)
        return found.select(*by, F.struct(*[c for c in found.columns if c not in by]).alias(name))

    checks = [c for c in statuses.columns if c not in (*by, "status")]
    document = statuses.select(*by, "status", F.struct(*checks).alias("checks"))
    for part in (lacking, shares, unmapped, integrity(raw, "raw"), integrity(processed, "processed")):
        document = document.join(part, by, "left")
    run = combined_status(statuses, metadata, run_id, at).select(
        "validation_id", "timestamp", F.col("status").alias("overall_status")
    )
    return document.withColumn("validation_id", F.lit(run_id)).join(run, "validation_id").select(
        "validation_id", "timestamp", "overall_status", F.col("source_file").alias("source"), "status", "checks",
        F.coalesce("missing_columns", F.array().cast("array<string>")).alias("missing_columns"),
        F.struct("missing", "unmapped").alias("warnings"), "raw", "processed",
    )


def run_summary(statuses: DataFrame, shares: DataFrame) -> DataFrame:
    """Per source: status, row counts and the columns with missing values to mention."""
    warnings = (
        shares.filter("mentioned")
        .groupBy("source_file")
        .agg(F.array_join(F.array_sort(F.collect_set("column")), ",").alias("warnings"))
    )
    return statuses.join(warnings, "source_file", "left").select(
        F.col("source_file").alias("source"),
        "status",
        "row_count_raw",
        "row_count_processed",
        F.coalesce("warnings", F.lit("")).alias("warnings"),
    )


# --- representation ----------------------------------------------------------


def value_counts(df: DataFrame, columns: Sequence[str] = BIAS_COLUMNS) -> DataFrame:
    """Frequency of every value of each column, missing as one row, with the missing share."""
    counts = unpivot(df, [], columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    missing = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    share = round_even(missing / F.sum("n") * 100, 2).alias("missing_pct")
    # One row per reported column.
    shares = F.broadcast(counts.groupBy("column").agg(share))
    return counts.join(shares, "column").withColumn("value", null_key_label(F.col("value")))


def top_categories(
    df: DataFrame, columns: Sequence[str] = BIAS_COLUMNS, limit: int = 5
) -> DataFrame:
    """Most frequent present values per column; ties by value."""
    counts = (
        unpivot(df, [], columns)
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def categorical_report(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Distinct lowered raw values per category column and source, sorted."""
    long = unpivot(df, [F.col(source).alias("source")], list(CATEGORIES))
    return long.filter(F.col("value").isNotNull()).distinct().orderBy("column", "source", "value")


def coercion_loss(raw: DataFrame, typed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Present raw cells that became null, per source and column.

    Counts per source need no row matching: present cells before minus present cells after.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        wide = df.groupBy("source_file").agg(*[F.count(c).alias(c) for c in columns])
        return unpivot(wide, ["source_file"], columns, "column", name)

    joined = counted(raw, "raw_present").join(
        counted(typed, "typed_present"), ["source_file", "column"]
    )
    return joined.withColumn("lost", F.col("raw_present") - F.col("typed_present"))
