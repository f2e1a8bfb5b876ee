"""Dedup, numbering, joins, set operations, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill import fixture
from reviewmill.catalog.registry import (
    INFO, day, deduped, final, from_deduped, from_final, from_raw, from_std, from_typed, query, r6,
    raw, standard, typed,
)
from reviewmill.fixture import table
from reviewmill.operators import dedup, enrich, numbering
from reviewmill.operators.search import topk_per_query
from reviewmill.plans import profile
from reviewmill.plans import standardize as std

# --- dedup -------------------------------------------------------------------

# Every 13th row loses all its mapped cells.
_HOLES = """holes AS (SELECT ord, source_file,
  CASE WHEN ord % 13 <> 0 THEN customer_name END AS customer_name,
  CASE WHEN ord % 13 <> 0 THEN review_text END AS review_text,
  CASE WHEN ord % 13 <> 0 THEN gender END AS gender FROM raw)"""


@query(
    "drop_empty_rows",
    from_raw("SELECT ord, customer_name, gender FROM holes WHERE customer_name IS NOT NULL "
             "OR review_text IS NOT NULL OR gender IS NOT NULL", _HOLES),
)
def drop_empty_rows(spark, sf):
    mapped = ["customer_name", "review_text", "gender"]
    holes = raw(spark, sf).select(
        "ord", *[F.when(F.col("ord") % 13 != 0, F.col(c)).alias(c) for c in mapped]
    )
    return dedup.drop_empty_rows(holes, mapped).select("ord", "customer_name", "gender")


@query(
    "dedup_text",
    from_typed("""SELECT ord, source_file, review_text FROM typed
      QUALIFY row_number() OVER (PARTITION BY source_file, review_text ORDER BY ord) = 1"""),
)
def dedup_text(spark, sf):
    return dedup.dedup_text(typed(spark, sf)).select("ord", "source_file", "review_text")


@query(
    "dedup_text_keep_null",
    from_typed("""SELECT ord, source_file, review_text FROM typed QUALIFY review_text IS NULL OR
      row_number() OVER (PARTITION BY source_file, review_text ORDER BY ord) = 1"""),
)
def dedup_text_keep_null(spark, sf):
    kept = dedup.dedup_text(typed(spark, sf), null_text="keep")
    return kept.select("ord", "source_file", "review_text")


_KEY = "source_file, customer_name, review_text, review_date, restaurant_name"


@query(
    "dedup_key",
    from_typed(f"""SELECT ord, customer_name, strftime(review_date, '%Y-%m-%d') AS review_date FROM typed
      QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY ord) = 1"""),
)
def dedup_key(spark, sf):
    kept = dedup.dedup_key(typed(spark, sf))
    return kept.select("ord", "customer_name", day("review_date").alias("review_date"))


@query("dedup_reviews", from_deduped("SELECT ord, source_file, customer_name, gender_norm FROM deduped"))
def dedup_reviews(spark, sf):
    return deduped(spark, sf).select("ord", "source_file", "customer_name", "gender_norm")


@query(
    "dedup_reviews_keep_null",
    from_typed(f"""SELECT ord, source_file FROM (SELECT * FROM typed QUALIFY review_text IS NULL OR
        row_number() OVER (PARTITION BY source_file, review_text ORDER BY ord) = 1)
      QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY ord) = 1"""),
)
def dedup_reviews_keep_null(spark, sf):
    kept = dedup.dedup_reviews(typed(spark, sf), null_text="keep")
    return kept.select("ord", "source_file")


@query(
    "dedup_counts",
    from_typed("""SELECT source_file, count(*) AS rows_before, count(*) AS rows_nonempty,
      CAST(count(DISTINCT review_text) + max((review_text IS NULL)::INT) AS BIGINT) AS rows_text,
      CAST(count(DISTINCT review_text) + max((review_text IS NULL)::INT) AS BIGINT) AS rows_key,
      CAST(count(*) - count(DISTINCT review_text) - max((review_text IS NULL)::INT) AS BIGINT) AS rows_dropped
      FROM typed GROUP BY 1"""),
)
def dedup_counts(spark, sf):
    rows = typed(spark, sf)
    return dedup.dedup_counts(rows, [c for c in std.MAPPED if c in rows.columns])


# --- numbering ---------------------------------------------------------------


@query("renumber_ids", from_final("SELECT review_id, ord, source_file FROM final"))
def renumber_ids(spark, sf):
    numbered = numbering.renumber(deduped(spark, sf), block_bits=10)
    return numbered.select("review_id", "ord", "source_file")


@query("dedup_and_renumber", from_final("SELECT review_id, ord, source_file, gender_norm FROM final"))
def dedup_and_renumber(spark, sf):
    return final(spark, sf).select("review_id", "ord", "source_file", "gender_norm")


@query(
    "renumber_all_rows",
    "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, "
    "l_orderkey, l_linenumber FROM lineitem",
)
def renumber_all_rows(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    numbered = numbering.number_rows(
        lines, lead=[], order="l_orderkey", id_column="row_id", block_bits=14,
        within=["l_linenumber", "l_partkey", "l_suppkey"],
    )
    return numbered.select("row_id", "l_orderkey", "l_linenumber")


# --- joins -------------------------------------------------------------------


@query(
    "enrich_left_join",
    from_deduped("""SELECT ord, d.restaurant_name, round(CAST(avg_stars AS DOUBLE), 6) AS avg_stars, total_reviews
      FROM deduped d LEFT JOIN (SELECT DISTINCT restaurant_name, avg_stars, total_reviews FROM info) i
      ON d.restaurant_name IS NOT DISTINCT FROM i.restaurant_name""", INFO),
)
def enrich_left_join(spark, sf):
    joined = enrich.enrich_left_join(deduped(spark, sf), fixture.restaurant_info(spark, sf))
    return joined.select(
        "ord", "restaurant_name", r6(F.col("avg_stars").cast("double")).alias("avg_stars"), "total_reviews"
    )


@query(
    "conflict_flag_join",
    from_typed("""SELECT ord, review_id FROM typed WHERE review_id IN (
      SELECT review_id FROM typed GROUP BY 1 HAVING count(DISTINCT customer_name) > 1)"""),
)
def conflict_flag_join(spark, sf):
    return enrich.flag_conflicts(typed(spark, sf)).select("ord", "review_id")


@query(
    "conflicting_ids",
    from_typed("""SELECT review_id FROM typed GROUP BY 1
      HAVING count(DISTINCT customer_name) > 1 OR count(DISTINCT review_text) > 1"""),
)
def conflicting_ids(spark, sf):
    return enrich.conflicting_ids(typed(spark, sf), by=["customer_name", "review_text"])


# --- set operations, order, limits -------------------------------------------


@query(
    "union_by_name",
    from_raw("""SELECT ord, source_file, gender, NULL AS age_range FROM raw WHERE restaurant_name = 'src1'
      UNION ALL SELECT ord, source_file, NULL, age_range FROM raw WHERE restaurant_name <> 'src1'"""),
)
def union_by_name(spark, sf):
    rows = raw(spark, sf)
    one = rows.filter("restaurant_name = 'src1'").select("ord", "source_file", "gender")
    others = rows.filter("restaurant_name <> 'src1'").select("age_range", "source_file", "ord")
    return profile.union_all([one, others]).select("ord", "source_file", "gender", "age_range")


@query("distinct_rows", "SELECT DISTINCT source, lang FROM documents")
def distinct_rows(spark, sf):
    return table(spark, sf, "documents").select("source", "lang").distinct()


@query("preview_rows", from_std("SELECT ord, review_id, gender FROM std ORDER BY ord LIMIT 6"))
def preview_rows(spark, sf):
    return profile.preview_rows(standard(spark, sf)).select("ord", "review_id", "gender")


@query(
    "head_n",
    "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 10",
)
def head_n(spark, sf):
    orders = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    return orders.select("o_orderkey", r6("o_totalprice").alias("o_totalprice"))


@query("sample_n", from_std("SELECT ord, source_file FROM std ORDER BY md5(ord::VARCHAR || ':42'), ord LIMIT 5"))
def sample_n(spark, sf):
    """Repeatable sample: the smallest digests of ordinal and seed."""
    return profile.sample_rows(standard(spark, sf)).select("ord", "source_file")


@query(
    "sort_report",
    from_typed("""SELECT "column", source_file AS source, "value" FROM (
      SELECT DISTINCT source_file, 'gender' AS "column", gender AS "value" FROM typed
      UNION SELECT DISTINCT source_file, 'age_range', age_range FROM typed
      UNION SELECT DISTINCT source_file, 'ethnicity', ethnicity FROM typed)
      WHERE "value" IS NOT NULL ORDER BY 1, 2, 3"""),
)
def sort_report(spark, sf):
    from reviewmill.plans.reports import categorical_report

    return categorical_report(typed(spark, sf))


@query(
    "topk_per_query",
    """SELECT user_id, event_id, round(value, 6) AS value, rank FROM (SELECT *,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events)
      WHERE rank <= 6""",
)
def topk(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "value")
    best = topk_per_query(events, 6, "user_id", "event_id", score=F.desc("value"))
    return best.select("user_id", "event_id", r6("value").alias("value"), "rank")
