"""The registry, the shared inputs and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill import fixture
from reviewmill.fixed import CATEGORIES
from reviewmill.functions.text import SPACE_CHARS, clean_text
from reviewmill.operators import dedup, numbering
from reviewmill.plans import standardize as std

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where it has one, its SQL twin."""

    def add(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return add


# --- inputs ------------------------------------------------------------------


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.reviews_raw(spark, sf_dir)


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return std.coerce_types(raw(spark, sf_dir))


def standard(spark: SparkSession, sf_dir: str, extended: bool = True) -> DataFrame:
    return std.standardize(raw(spark, sf_dir), extended=extended)


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed rows with a digest of each text, made before the joins."""
    return std.coerce_types(fixture.reviews_raw(spark, sf_dir, lambda c: F.sha2(clean_text(c), 256)))


def deduped(spark: SparkSession, sf_dir: str, extended: bool = True) -> DataFrame:
    return dedup.dedup_reviews(standard(spark, sf_dir, extended), keys=text_keys(spark, sf_dir))


def final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated and numbered 1..N. The fixture's ordinals are dense: 2^20 rows per block."""
    return numbering.dedup_and_renumber(
        standard(spark, sf_dir), block_bits=20, keys=text_keys(spark, sf_dir)
    )


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- their SQL twins ---------------------------------------------------------

_SPACES = " || ".join(f"chr({ord(ch)})" for ch in SPACE_CHARS)


def strip_sql(column: str) -> str:
    return f"trim({column}, {_SPACES})"


def norm_sql(raw_column: str) -> str:
    table = CATEGORIES[raw_column][1]
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {raw_column} {cases} ELSE {raw_column} END"


RAW = "raw AS (" + fixture.plain(fixture.REVIEWS_RAW) + ")"
INFO = "info AS (" + fixture.plain(fixture.RESTAURANT_INFO) + ")"
TYPED = f"""typed AS (
  SELECT source_file, ord, review_id,
    {strip_sql('customer_name')} AS customer_name,
    {strip_sql('location')} AS location,
    {strip_sql('restaurant_name')} AS restaurant_name,
    nullif({strip_sql('review_text')}, '') AS review_text,
    CASE WHEN review_date LIKE '%/%' THEN try_strptime(review_date, '%m/%d/%Y')
         ELSE try_strptime(review_date, '%Y-%m-%d') END AS review_date,
    TRY_CAST(rating_raw AS DOUBLE) AS rating_raw,
    CAST(total_spent AS DOUBLE) AS total_spent,
    CAST(tip_amount AS DOUBLE) AS tip_amount,
    CAST(tip_percentage AS DOUBLE) AS tip_raw,
    CAST(party_size AS DOUBLE) AS party_size,
    lower({strip_sql('age_range')}) AS age_range,
    lower({strip_sql('gender')}) AS gender,
    lower({strip_sql('ethnicity')}) AS ethnicity
  FROM raw)"""
SCALED = """scaled AS (
  SELECT *, CASE WHEN top > 5 AND top <= 10 THEN 10 WHEN top > 10 AND top <= 100 THEN 100
                 ELSE 5 END AS rating_scale,
    CASE WHEN (tip_raw IS NULL OR tip_raw = 0) AND total_spent > 0 AND tip_amount IS NOT NULL
         THEN tip_amount / total_spent * 100 ELSE tip_raw END AS tip_filled
  FROM (SELECT *, max(rating_raw) OVER (PARTITION BY source_file) AS top FROM typed))"""
STD = f"""std AS (
  SELECT * EXCLUDE (top, tip_raw, tip_filled),
    rating_raw / rating_scale * 5.0 AS rating_1_5,
    CASE WHEN tip_filled > 30 THEN 30.0 ELSE tip_filled END AS tip_percentage,
    {norm_sql('gender')} AS gender_norm,
    {norm_sql('ethnicity')} AS ethnicity_norm,
    {norm_sql('age_range')} AS age_group,
    CASE WHEN total_spent IS NOT NULL THEN ln(1 + greatest(total_spent, 0)) END AS log_total_spent,
    CAST(length(review_text) AS INTEGER) AS review_length,
    substr(review_text, 1, 2000) AS review_text_trunc
  FROM scaled)"""
DEDUPED = """deduped AS (
  SELECT * FROM std
  QUALIFY row_number() OVER (PARTITION BY source_file, review_text ORDER BY ord) = 1)"""
FINAL = """final AS (
  SELECT * REPLACE (row_number() OVER (ORDER BY source_file, ord) AS review_id) FROM deduped)"""

_STEPS = [RAW, TYPED, SCALED, STD, DEDUPED, FINAL]


def _with(count: int, select: str, *more: str) -> str:
    return "WITH " + ",\n".join([*_STEPS[:count], *more]) + "\n" + select


def from_raw(select: str, *more: str) -> str:
    return _with(1, select, *more)


def from_typed(select: str, *more: str) -> str:
    return _with(2, select, *more)


def from_scaled(select: str, *more: str) -> str:
    return _with(3, select, *more)


def from_std(select: str, *more: str) -> str:
    return _with(4, select, *more)


def from_deduped(select: str, *more: str) -> str:
    return _with(5, select, *more)


def from_final(select: str, *more: str) -> str:
    return _with(6, select, *more)
