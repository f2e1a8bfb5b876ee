"""Integrity, validation and representation reports; exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill import fixture
from reviewmill.catalog.registry import (
    INFO, day, deduped, final, from_deduped, from_final, from_raw, from_std, from_typed, query, r6,
    raw, standard, typed,
)
from reviewmill.fixed import CATEGORIES, WAIT_WORDS
from reviewmill.functions.text import SPACE_CLASS
from reviewmill.plans import profile, reports

# --- integrity ---------------------------------------------------------------


@query(
    "integrity_totals",
    from_std("""SELECT source_file, count(*) AS total_rows, count(DISTINCT review_id) AS unique_reviews,
      count(*) - count(DISTINCT review_id) AS duplicate_reviews,
      count(DISTINCT customer_name) AS unique_customers FROM std GROUP BY 1"""),
)
def integrity_totals(spark, sf):
    return reports.integrity_totals(standard(spark, sf))


_WATCHED = ["review_id", "customer_name", "location", "restaurant_name", "review_text", "review_date",
            "rating_raw", "rating_scale", "rating_1_5", "total_spent", "tip_amount", "tip_percentage",
            "party_size", "age_range", "gender", "ethnicity", "age_group", "gender_norm", "ethnicity_norm",
            "log_total_spent", "review_length", "review_text_trunc"]


def _missing_sql(relation: str) -> str:
    return " UNION ALL ".join(
        f"SELECT source_file, '{c}' AS \"column\", avg(({c} IS NULL)::INT) AS missing FROM {relation} GROUP BY 1"
        for c in _WATCHED
    )


@query(
    "missingness",
    from_deduped("SELECT source_file, \"column\", round(missing, 6) AS missing FROM ("
                 + _missing_sql("deduped") + ") WHERE missing > 0"),
)
def missingness(spark, sf):
    shares = reports.missingness(deduped(spark, sf), _WATCHED)
    return shares.select("source_file", "column", r6("missing").alias("missing"))


@query(
    "by_restaurant",
    from_std("""SELECT source_file, restaurant_name, reviews, unique_customers,
      round_even(reviews / total * 100, 2) AS reviews_pct FROM (
        SELECT source_file, restaurant_name, count(review_id) AS reviews,
          count(DISTINCT customer_name) AS unique_customers,
          sum(count(*)) OVER (PARTITION BY source_file) AS total
        FROM (SELECT * REPLACE (CASE WHEN ord % 4 = 0 THEN location WHEN ord % 4 = 1 THEN NULL
              ELSE restaurant_name END AS restaurant_name) FROM std) GROUP BY 1, 2)
      WHERE restaurant_name IS NOT NULL"""),
)
def by_restaurant(spark, sf):
    """Restaurant names are varied inside a source, and missing for a quarter of the rows."""
    name = F.when(F.col("ord") % 4 == 0, F.col("location")).when(
        F.col("ord") % 4 != 1, F.col("restaurant_name")
    )
    return reports.by_restaurant(standard(spark, sf).withColumn("restaurant_name", name))


# --- validation --------------------------------------------------------------


@query(
    "required_columns",
    from_std(" UNION ALL ".join(
        f"SELECT source_file AS source, count(*) AS n_rows, '{c}' AS missing_column FROM std GROUP BY 1 {having}"
        for c, having in (("review_id", "HAVING count(review_id) = 0"), ("rating_1_5", "HAVING count(rating_1_5) = 0"),
                          ("review_text", "HAVING count(review_text) = 0"), ("menu_item", "")))),
)
def required_columns(spark, sf):
    """Sources whose ratings are words have none; no source has the last column."""
    return reports.required_columns(standard(spark, sf), [*reports.REVIEW_REQUIRED, "menu_item"])


_DUPES = "count(*) - count(DISTINCT review_id) - max((review_id IS NULL)::INT)"


@query("duplicate_ids", from_deduped(f"SELECT source_file, CAST({_DUPES} AS BIGINT) AS duplicate_ids FROM deduped GROUP BY 1"))
def duplicate_ids(spark, sf):
    return reports.duplicate_ids(deduped(spark, sf))


_COUNTS = """counts AS (SELECT source_file, row_count_raw, row_count_processed,
    row_count_raw - row_count_processed AS row_count_mismatch
  FROM (SELECT source_file, count(*) AS row_count_raw FROM raw GROUP BY 1)
  JOIN (SELECT source_file, count(*) AS row_count_processed FROM deduped GROUP BY 1) USING (source_file))"""
_CONFLICTS = """conflicts AS (SELECT source_file, CAST(count(*) FILTER (customers > 1) AS BIGINT) AS conflicting_ids
  FROM (SELECT source_file, review_id, count(DISTINCT customer_name) AS customers FROM raw
        WHERE review_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


@query("row_count_mismatch", from_deduped("SELECT * FROM counts", _COUNTS))
def row_count_mismatch(spark, sf):
    return reports.row_count_mismatch(raw(spark, sf), deduped(spark, sf))


@query(
    "range_checks",
    from_deduped("""SELECT source_file, count(*) FILTER (rating_1_5 < 1 OR rating_1_5 > 5) AS invalid_ratings,
      count(*) FILTER (tip_percentage > 30) AS extreme_tips,
      count(*) FILTER (review_length > 2000) AS long_reviews FROM deduped GROUP BY 1"""),
)
def range_checks(spark, sf):
    return reports.range_checks(deduped(spark, sf))


@query(
    "missing_thresholds",
    from_typed("""SELECT source_file, "column", round(missing, 6) AS missing, missing > 0 AS mentioned,
      missing > lim AS over_limit FROM (
        SELECT source_file, 'review_text' AS "column", avg((review_text IS NULL)::INT) AS missing, 0.4 AS lim FROM typed GROUP BY 1
        UNION ALL SELECT source_file, 'age_range', avg((age_range IS NULL)::INT), 0.2 FROM typed GROUP BY 1)"""),
)
def missing_thresholds(spark, sf):
    shares = reports.missing_thresholds(typed(spark, sf))
    return shares.select("source_file", "column", r6("missing").alias("missing"), "mentioned", "over_limit")


@query(
    "null_text_fail",
    from_typed("""SELECT source_file, round(avg((review_text IS NULL)::INT), 6) AS null_review_text,
      avg((review_text IS NULL)::INT) > 0.5 AS failed FROM typed GROUP BY 1"""),
)
def null_text_fail(spark, sf):
    shares = reports.null_text_fail(typed(spark, sf))
    return shares.withColumn("null_review_text", r6("null_review_text"))


def _known(column: str) -> str:
    return ", ".join(f"'{k}'" for k in CATEGORIES[column][1])


@query(
    "unmapped_categories",
    from_std(" UNION ALL ".join(
        f"SELECT DISTINCT source_file, '{c}' AS \"column\", {c} AS \"value\", false AS parity FROM std "
        f"WHERE {c} NOT IN ({_known(c)})" for c in CATEGORIES)),
)
def unmapped_categories(spark, sf):
    return reports.unmapped_categories(standard(spark, sf))


_CHECKS = """checks AS (SELECT c.source_file, c.row_count_raw, c.row_count_processed, c.row_count_mismatch,
    f.* EXCLUDE (source_file), coalesce(x.conflicting_ids, 0) AS conflicting_ids
  FROM counts c JOIN (SELECT source_file, CAST(""" + _DUPES + """ AS BIGINT) AS duplicate_ids,
      count(*) FILTER (rating_1_5 < 1 OR rating_1_5 > 5) AS invalid_ratings,
      count(*) FILTER (tip_percentage > 30) AS extreme_tips,
      count(*) FILTER (review_length > 2000) AS long_reviews,
      avg((review_text IS NULL)::INT) AS null_text, avg((age_range IS NULL)::INT) AS null_age
    FROM deduped GROUP BY 1) f USING (source_file)
  LEFT JOIN conflicts x USING (source_file)),
status AS (SELECT *, CASE WHEN duplicate_ids > 0 OR row_count_mismatch <> 0 OR invalid_ratings > 0
    OR extreme_tips > 0 OR long_reviews > 0 OR null_text > 0.5 THEN 'fail'
    WHEN null_text > 0.4 OR null_age > 0.2 OR conflicting_ids > 0 THEN 'warn' ELSE 'pass' END AS status
  FROM checks)"""
_REPORT = [_COUNTS, _CONFLICTS, _CHECKS]


def _statuses(spark, sf):
    checks = reports.validation_checks(deduped(spark, sf), raw(spark, sf))
    return reports.source_status(checks)


@query(
    "validation_checks",
    from_deduped("""SELECT source_file, row_count_raw, row_count_processed, row_count_mismatch, duplicate_ids,
      invalid_ratings, extreme_tips, long_reviews, round(null_text, 6) AS null_text,
      round(null_age, 6) AS null_age, conflicting_ids FROM checks""", *_REPORT),
)
def validation_checks(spark, sf):
    checks = reports.validation_checks(deduped(spark, sf), raw(spark, sf))
    return checks.drop("unmapped_rows").withColumns({"null_text": r6("null_text"), "null_age": r6("null_age")})


@query("source_status", from_deduped("SELECT source_file, status FROM status", *_REPORT))
def source_status(spark, sf):
    return _statuses(spark, sf).select("source_file", "status")


_META = """meta AS (SELECT 'restaurant_info' AS source, count(*) AS row_count, 0::BIGINT AS missing_columns,
    count(*) FILTER (avg_stars < 1 OR avg_stars > 5) AS invalid_avg_stars,
    count(*) FILTER (total_reviews < 0) AS invalid_total_reviews FROM info)"""


@query(
    "validate_metadata",
    f"""WITH {INFO}, {_META} SELECT *, CASE WHEN invalid_avg_stars > 0 OR invalid_total_reviews > 0
      THEN 'fail' ELSE 'pass' END AS status FROM meta""",
)
def validate_metadata(spark, sf):
    return reports.validate_metadata(fixture.restaurant_info(spark, sf), "restaurant_info")


@query(
    "dedup_metrics",
    from_deduped("""SELECT source_file, row_count_mismatch AS rows_dropped_dedup,
      coalesce(conflicting_ids, 0) AS conflicting_ids FROM counts LEFT JOIN conflicts USING (source_file)""",
                 _COUNTS, _CONFLICTS),
)
def dedup_metrics(spark, sf):
    return reports.dedup_metrics(raw(spark, sf), deduped(spark, sf))


@query(
    "combined_status",
    from_deduped("""SELECT 'run-1' AS validation_id, '2024-01-01T00:00:00' AS timestamp, count(*) AS sources,
      CASE max(rank) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status FROM (
        SELECT CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS rank FROM status
        UNION ALL SELECT CASE WHEN invalid_avg_stars > 0 OR invalid_total_reviews > 0 THEN 2 ELSE 0 END FROM meta)""",
                 *_REPORT, INFO, _META),
)
def combined_status(spark, sf):
    meta = reports.validate_metadata(fixture.restaurant_info(spark, sf), "restaurant_info")
    return reports.combined_status(_statuses(spark, sf), meta, "run-1", "2024-01-01T00:00:00")


@query(
    "run_summary",
    from_deduped("""SELECT source_file AS source, status, row_count_raw, row_count_processed,
      concat_ws(',', CASE WHEN null_age > 0 THEN 'age_range' END,
        CASE WHEN null_text > 0 THEN 'review_text' END) AS warnings FROM status""", *_REPORT),
)
def run_summary(spark, sf):
    shares = reports.missing_thresholds(deduped(spark, sf))
    return reports.run_summary(_statuses(spark, sf), shares)


def _totals_sql(relation: str) -> str:
    return (f"SELECT source_file, count(*) AS total_rows, count(DISTINCT review_id) AS unique_reviews, "
            f"count(DISTINCT customer_name) AS unique_customers FROM {relation} GROUP BY 1")


def _unknown_sql(column: str) -> str:
    known = ", ".join(f"'{k}'" for k in CATEGORIES[column][1])
    return (f"SELECT source_file, '{column}' AS \"column\", count(DISTINCT {column}) AS n FROM deduped "
            f"WHERE {column} NOT IN ({known}) GROUP BY 1")


@query(
    "validation_document",
    from_deduped(f"""SELECT 'run-1' AS validation_id, '2024-01-01T00:00:00' AS timestamp,
      CASE WHEN bool_or(status = 'fail') OVER () THEN 'fail' WHEN bool_or(status = 'warn') OVER () THEN 'warn'
        ELSE 'pass' END AS overall_status,
      source_file AS source, status, row_count_mismatch, conflicting_ids,
      CASE WHEN ratings = 0 THEN 'rating_1_5' ELSE '' END AS missing_columns,
      concat_ws(';', CASE WHEN null_age > 0 THEN 'age_range=' || round(null_age * 10000)::BIGINT END,
        CASE WHEN null_text > 0 THEN 'review_text=' || round(null_text * 10000)::BIGINT END) AS missing,
      coalesce(u.listed, '') AS unmapped, r.total_rows AS raw_rows, r.unique_reviews AS raw_reviews,
      p.total_rows AS processed_rows, p.unique_customers AS processed_customers
    FROM status JOIN ({_totals_sql('raw')}) r USING (source_file) JOIN ({_totals_sql('deduped')}) p USING (source_file)
    JOIN (SELECT source_file, count(rating_1_5) AS ratings FROM deduped GROUP BY 1) USING (source_file)
    LEFT JOIN (SELECT source_file, string_agg("column" || '=' || n, ';' ORDER BY "column") AS listed FROM (
      {' UNION ALL '.join(map(_unknown_sql, CATEGORIES))}) GROUP BY 1) u USING (source_file)""", *_REPORT),
)
def validation_document(spark, sf):
    """Lists are shown as text; shares in hundredths of a percent."""
    before, after = raw(spark, sf), deduped(spark, sf)
    document = reports.validation_document(
        _statuses(spark, sf), before, after, run_id="run-1", at="2024-01-01T00:00:00"
    )

    def shown(items, value):
        return F.coalesce(F.array_join(F.transform(items, lambda x: F.concat_ws("=", x["column"], value(x))), ";"), F.lit(""))

    return document.select(
        "validation_id", "timestamp", "overall_status", "source", "status",
        "checks.row_count_mismatch", "checks.conflicting_ids",
        F.array_join("missing_columns", ",").alias("missing_columns"),
        shown("warnings.missing", lambda x: F.round(x["missing"] * 10000).cast("long").cast("string")).alias("missing"),
        shown("warnings.unmapped", lambda x: x["n_values"].cast("string")).alias("unmapped"),
        F.col("raw.total_rows").alias("raw_rows"), F.col("raw.unique_reviews").alias("raw_reviews"),
        F.col("processed.total_rows").alias("processed_rows"),
        F.col("processed.unique_customers").alias("processed_customers"),
    )


# --- representation ----------------------------------------------------------


def _long_sql(relation: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS \"value\" FROM {relation}" for c in columns)


@query(
    "value_counts",
    from_deduped("""SELECT "column", coalesce("value", 'NA') AS "value", n,
      round_even(CAST(sum(n) FILTER (WHERE "value" IS NULL) OVER (PARTITION BY "column") AS DOUBLE)
        / sum(n) OVER (PARTITION BY "column") * 100, 2) AS missing_pct FROM (
      SELECT "column", "value", count(*) AS n FROM (""" + _long_sql("deduped", reports.BIAS_COLUMNS)
                 + ") GROUP BY 1, 2)"),
)
def value_counts(spark, sf):
    return reports.value_counts(deduped(spark, sf))


@query(
    "top_categories",
    from_deduped("""SELECT "column", "value", n, place FROM (SELECT *,
        CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, "value") AS INTEGER) AS place
      FROM (SELECT "column", "value", count(*) AS n FROM (""" + _long_sql("deduped", reports.BIAS_COLUMNS)
                 + """) WHERE "value" IS NOT NULL GROUP BY 1, 2)) WHERE place <= 5"""),
)
def top_categories(spark, sf):
    return reports.top_categories(deduped(spark, sf))


@query(
    "categorical_report",
    from_typed("""SELECT DISTINCT "column", source, "value" FROM (""" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", source_file AS source, {c} AS \"value\" FROM typed" for c in CATEGORIES
    ) + """) WHERE "value" IS NOT NULL"""),
)
def categorical_report(spark, sf):
    return reports.categorical_report(typed(spark, sf))


_COERCED = ["review_id", "customer_name", "location", "restaurant_name", "review_text", "review_date", "rating_raw",
            "total_spent", "tip_amount", "party_size", "age_range", "gender", "ethnicity"]


@query(
    "coercion_loss",
    from_typed(" UNION ALL ".join(
        f"SELECT r.source_file, '{c}' AS \"column\", count(r.{c}) AS raw_present, count(t.{c}) AS typed_present, "
        f"count(r.{c}) - count(t.{c}) AS lost FROM raw r JOIN typed t USING (ord) GROUP BY 1"
        for c in _COERCED)),
)
def coercion_loss(spark, sf):
    return reports.coercion_loss(raw(spark, sf), typed(spark, sf), _COERCED)


# --- exploration -------------------------------------------------------------


@query(
    "describe",
    from_std(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, "
        "round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS q25, "
        "round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75 "
        f"FROM (SELECT CAST({c} AS DOUBLE) AS v FROM std)" for c in profile.NUMERIC)),
)
def describe(spark, sf):
    stats = profile.describe(standard(spark, sf))
    rounded = {c: r6(c) for c in ("min", "max", "q25", "q50", "q75")}
    rounded.update({c: F.round(c, 4) for c in ("mean", "std")})
    return stats.withColumns(rounded)


@query(
    "describe_by_slices",
    """SELECT 'l_extendedprice' AS "column", count(*) AS count, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
      round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75
      FROM lineitem""",
)
def describe_by_slices(spark, sf):
    """The same statistics by narrowing, as for a column too large for one task."""
    lines = fixture.table(spark, sf, "lineitem")
    stats = profile.describe(lines, ["l_extendedprice"], accuracy=200)
    return stats.select("column", "count", *[r6(q).alias(q) for q in ("q25", "q50", "q75")])


@query(
    "scale_by_source",
    from_std("""SELECT source_file, min(rating_scale) AS min_scale, max(rating_scale) AS max_scale,
      count(DISTINCT rating_scale) AS n_scales FROM std GROUP BY 1"""),
)
def scale_by_source(spark, sf):
    return profile.scale_by_source(standard(spark, sf))


@query(
    "quantile_outliers",
    from_std("""SELECT ord, round(total_spent, 6) AS total_spent, source_file FROM std
      WHERE total_spent > (SELECT quantile_cont(total_spent, 0.99) FROM std)"""),
)
def quantile_outliers(spark, sf):
    rows = profile.quantile_outliers(standard(spark, sf))
    return rows.select("ord", r6("total_spent").alias("total_spent"), "source_file")


_BINNED = ["rating_1_5", "total_spent", "tip_percentage", "party_size"]


@query(
    "histogram",
    from_std(" UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(least(floor((v - lo) / ((hi - lo) / 25.0)) + 1, 25) AS INTEGER) AS bin,
          round(lo, 6) AS lo, round(hi, 6) AS hi, count(*) AS n
          FROM (SELECT {c} AS v FROM std), (SELECT min({c}) AS lo, max({c}) AS hi FROM std)
          WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4""" for c in _BINNED)),
)
def histogram(spark, sf):
    bins = profile.histogram(standard(spark, sf), _BINNED)
    return bins.withColumns({"lo": r6("lo"), "hi": r6("hi")})


@query(
    "dup_candidates",
    from_std(f"""SELECT customer_name, text_norm, strftime(review_date, '%Y-%m-%d') AS review_date, restaurant_name,
      count(*) AS n, min(ord) AS first_ord
      FROM (SELECT *, regexp_replace(lower(review_text), '{SPACE_CLASS}+', ' ', 'g') AS text_norm FROM std)
      GROUP BY customer_name, text_norm, std_date(review_date), restaurant_name ORDER BY n DESC, first_ord LIMIT 10"""
             .replace("std_date(review_date)", "review_date")),
)
def dup_candidates(spark, sf):
    found = profile.dup_candidates(standard(spark, sf))
    return found.withColumn("review_date", day("review_date"))


_BLANKS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (coalesce({c}, '') = '') AS blank FROM std"
    for c in profile.TEXT_COLUMNS
)


@query("blank_counts", from_std(_BLANKS))
def blank_counts(spark, sf):
    return profile.blank_counts(standard(spark, sf))


_WAITING = " OR ".join(f"contains(lower(review_text), '{w}')" for w in WAIT_WORDS)


@query("sum_flags", from_final(f"SELECT count(*) FILTER ({_WAITING}) AS rows_waiting FROM final"))
def sum_flags(spark, sf):
    return profile.sum_flags(final(spark, sf))
