"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill.catalog.registry import (
    day, final, from_final, from_raw, from_scaled, from_std, from_typed,
    query, r6, raw, standard, strip_sql, typed,
)
from reviewmill.fixed import NORM_COLUMNS, PREVIEW_CHARS, STANDARD_COLUMNS, WAIT_WORDS
from reviewmill.fixture import from_sql, table
from reviewmill.functions import dates, numbers, text
from reviewmill.operators.search import filter_terms
from reviewmill.plans import evaluate, index, reports
from reviewmill.plans import standardize as std

# --- numbers -----------------------------------------------------------------

# Cells in many spellings, made from the rows themselves.
NUMBER_CELLS = """
  SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN ' ' || n_chars || ' ' WHEN 1 THEN n_chars || '.5'
    WHEN 2 THEN '+' || n_chars WHEN 3 THEN '-.' || n_chars WHEN 4 THEN n_chars || 'e-2'
    WHEN 5 THEN n_chars || 'd' WHEN 6 THEN '1,' || n_chars WHEN 7 THEN 'n/a ' || n_chars
    WHEN 8 THEN '' WHEN 9 THEN n_chars || '.' END AS cell
  FROM {documents}
"""


@query(
    "coerce_numeric",
    "SELECT doc_id, round(CASE WHEN regexp_full_match(trim(cell), "
    "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim(cell) AS DOUBLE) END, 6)"
    " AS number FROM (" + NUMBER_CELLS.replace("{documents}", "documents") + ")",
)
def coerce_numeric(spark, sf):
    cells = from_sql(spark, sf, NUMBER_CELLS)
    return cells.select("doc_id", r6(numbers.coerce_numeric(F.col("cell"))).alias("number"))


@query("infer_rating_scale", from_scaled("SELECT DISTINCT source_file, rating_scale FROM scaled"))
def infer_rating_scale(spark, sf):
    return std.rating_scales(typed(spark, sf)).select("source_file", "rating_scale")


@query(
    "rating_1_5",
    from_std("SELECT ord, round(rating_raw, 6) AS rating_raw, rating_scale, "
             "round(rating_1_5, 6) AS rating_1_5 FROM std"),
)
def rating_1_5(spark, sf):
    return standard(spark, sf).select(
        "ord", r6("rating_raw").alias("rating_raw"), "rating_scale", r6("rating_1_5").alias("rating_1_5")
    )


@query("scale_broadcast", from_scaled("SELECT ord, source_file, rating_scale FROM scaled"))
def scale_broadcast(spark, sf):
    rows = typed(spark, sf)
    return std.apply_scales(rows, std.rating_scales(rows)).select("ord", "source_file", "rating_scale")


@query("tip_fill", from_scaled("SELECT ord, round(tip_filled, 6) AS tip_percentage FROM scaled"))
def tip_fill(spark, sf):
    filled = numbers.tip_fill(F.col("tip_percentage"), F.col("total_spent"), F.col("tip_amount"))
    return typed(spark, sf).select("ord", r6(filled).alias("tip_percentage"))


@query(
    "tip_cap",
    from_typed("SELECT ord, CASE WHEN tip_raw > 30 THEN 30.0::DOUBLE ELSE tip_raw END AS tip_percentage"
               " FROM typed"),
)
def tip_cap(spark, sf):
    capped = numbers.tip_cap(F.col("tip_percentage"))
    return typed(spark, sf).select("ord", capped.alias("tip_percentage"))


@query(
    "log_spent",
    from_typed("SELECT ord, round(CASE WHEN total_spent IS NOT NULL THEN "
               "ln(1 + greatest(total_spent, 0)) END, 6) AS log_total_spent FROM typed"),
)
def log_spent(spark, sf):
    return typed(spark, sf).select(
        "ord", r6(numbers.log_spent(F.col("total_spent"))).alias("log_total_spent")
    )


# --- strings -----------------------------------------------------------------

_PADDED = "chr(9) || chr(12288) || review_text || chr(160) || chr(28)"
_PADDED_SPARK = "concat(char(9), decode(unhex('E38080'), 'UTF-8'), review_text, char(160), char(28))"


@query(
    "coerce_str",
    from_raw(f"SELECT ord, {strip_sql('customer_name')} AS customer_name, "
             f"{strip_sql(_PADDED)} AS padded FROM raw"),
)
def coerce_str(spark, sf):
    return raw(spark, sf).select(
        "ord",
        text.coerce_str(F.col("customer_name")).alias("customer_name"),
        text.coerce_str(F.expr(_PADDED_SPARK)).alias("padded"),
    )


@query("clean_text", from_raw(f"SELECT ord, nullif({strip_sql('review_text')}, '') AS review_text FROM raw"))
def clean_text(spark, sf):
    return raw(spark, sf).select("ord", text.clean_text(F.col("review_text")).alias("review_text"))


@query("coerce_date", from_typed("SELECT ord, strftime(review_date, '%Y-%m-%d') AS review_date FROM typed"))
def coerce_date(spark, sf):
    parsed = dates.coerce_date(F.col("review_date"))
    return raw(spark, sf).select("ord", day(parsed).alias("review_date"))


@query(
    "coerce_date_strict",
    from_raw("""SELECT ord, strftime(CASE WHEN slash = first_slash THEN CASE WHEN slash
      THEN try_strptime(review_date, '%m/%d/%Y') ELSE try_strptime(review_date, '%Y-%m-%d') END END,
      '%Y-%m-%d') AS review_date
      FROM (SELECT *, review_date LIKE '%/%' AS slash,
              first_value(review_date LIKE '%/%') OVER (PARTITION BY source_file ORDER BY ord) AS first_slash
            FROM raw)"""),
)
def coerce_date_strict(spark, sf):
    strict = std.coerce_types(raw(spark, sf), date_mode="strict")
    return strict.select("ord", day("review_date").alias("review_date"))


_SLASHED = from_typed(
    """SELECT ord, strftime(CASE WHEN votes > 0
        THEN coalesce(try_strptime(cell, '%d/%m/%Y'), try_strptime(cell, '%m/%d/%Y'))
        ELSE coalesce(try_strptime(cell, '%m/%d/%Y'), try_strptime(cell, '%d/%m/%Y')) END, '%Y-%m-%d') AS review_date
      FROM (SELECT *, sum(CASE WHEN CAST(cell[1:2] AS INT) > 12 THEN 1 WHEN CAST(cell[4:5] AS INT) > 12 THEN -1
              ELSE 0 END) OVER (PARTITION BY source_file) AS votes FROM slashed)""",
    """slashed AS (SELECT ord, source_file, CASE WHEN source_file = (SELECT min(source_file) FROM raw)
      THEN strftime(review_date, '%d/%m/%Y') ELSE strftime(review_date, '%m/%d/%Y') END AS cell FROM typed)""",
)


@query("coerce_date_by_source", _SLASHED)
def coerce_date_by_source(spark, sf):
    """Dates written with slashes, in one source with the day first, in the others with the month first."""
    rows = typed(spark, sf).select("ord", "source_file", "review_date")
    first = rows.agg(F.min("source_file")).first()[0]
    written = F.when(F.col("source_file") == F.lit(first), F.date_format("review_date", "dd/MM/yyyy"))
    cells = rows.withColumn("review_date", written.otherwise(F.date_format("review_date", "MM/dd/yyyy")))
    read = std.coerce_types(std.apply_facts(cells, std.source_facts(cells)))
    return read.select("ord", day("review_date").alias("review_date"))


@query(
    "text_len_trunc",
    from_std("SELECT ord, CAST(review_length AS BIGINT) AS review_length, review_text_trunc FROM std"),
)
def text_len_trunc(spark, sf):
    c = F.col("review_text")
    return typed(spark, sf).select(
        "ord",
        text.text_length(c).cast("long").alias("review_length"),
        text.text_trunc(c).alias("review_text_trunc"),
    )


@query("map_category", from_std("SELECT ord, gender_norm, ethnicity_norm, age_group FROM std"))
def map_category(spark, sf):
    return standard(spark, sf).select("ord", "gender_norm", "ethnicity_norm", "age_group")


@query(
    "row_key",
    from_typed("SELECT ord, coalesce(restaurant_name, 'NA') || '_' || "
               "coalesce(strftime(review_date, '%Y-%m-%d %H:%M:%S'), 'NA') || '_' || "
               "substr(sha256(source_file || chr(31) || ord), 1, 8) AS unique_id FROM typed"),
)
def row_key(spark, sf):
    return standard(spark, sf).select("ord", "unique_id")


@query(
    "norm_ws",
    f"SELECT doc_id, trim(regexp_replace(text, '{text.SPACE_CLASS}+', ' ', 'g')) AS text FROM documents",
)
def norm_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.norm_ws(F.col("text")).alias("text"))


@query(
    "norm_text_dupkey",
    from_raw(f"SELECT ord, regexp_replace(lower(review_text), '{text.SPACE_CLASS}+', ' ', 'g') AS text_norm FROM raw"),
)
def norm_text_dupkey(spark, sf):
    return raw(spark, sf).select("ord", text.norm_text_dupkey(F.col("review_text")).alias("text_norm"))


_WAITING = " OR ".join(f"contains(lower(review_text), '{w}')" for w in WAIT_WORDS)


@query("mentions_any", from_std(f"SELECT ord, coalesce({_WAITING}, false) AS mentions_wait FROM std"))
def mentions_any(spark, sf):
    return typed(spark, sf).select("ord", text.mentions_any(F.col("review_text")).alias("mentions_wait"))


@query(
    "fmt_pct",
    from_std("SELECT source_file, round(avg((age_range IS NULL)::INT), 6) AS missing, "
             "printf('%.1f%%', 100 * avg((age_range IS NULL)::INT)) AS missing_text FROM std GROUP BY 1"),
)
def fmt_pct(spark, sf):
    shares = reports.missing_fractions(typed(spark, sf), ["age_range"])
    return shares.select(
        "source_file", r6("missing").alias("missing"), text.fmt_pct(F.col("missing")).alias("missing_text")
    )


@query(
    "preview_text",
    f"SELECT conv_id, turn, substr(text, 1, {PREVIEW_CHARS}) AS preview FROM conversations WHERE role = 'assistant'",
)
def preview_text(spark, sf):
    answers = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return answers.select("conv_id", "turn", text.preview_text(F.col("text")).alias("preview"))


@query(
    "null_key_label",
    from_typed("SELECT coalesce(ethnicity, 'NA') AS ethnicity, count(*) AS n FROM typed GROUP BY typed.ethnicity"),
)
def null_key_label(spark, sf):
    counts = typed(spark, sf).groupBy("ethnicity").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ethnicity", text.null_key_label(F.col("ethnicity")))


# --- projections and predicates ----------------------------------------------


@query("add_source_col", from_raw("SELECT source_file, count(*) AS n FROM raw GROUP BY 1"))
def add_source_col(spark, sf):
    from reviewmill.catalog.files import scanned

    return scanned(spark, sf).groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "source_file", F.regexp_replace("source_file", "txt$", "csv")
    )


@query(
    "fill_missing_cols",
    from_raw("SELECT ord, review_id, CAST(NULL AS VARCHAR) AS location, CAST(NULL AS DOUBLE) AS tip_amount, "
             "CAST(NULL AS VARCHAR) AS gender FROM raw"),
)
def fill_missing_cols(spark, sf):
    narrow = raw(spark, sf).select("ord", "review_id", "source_file")
    return std.fill_missing_columns(narrow).select("ord", "review_id", "location", "tip_amount", "gender")


_STANDARD = [n for n, _ in STANDARD_COLUMNS + NORM_COLUMNS]
_DOUBLES = [n for n, t in STANDARD_COLUMNS if t == "double"]


def _standard_sql(columns=_STANDARD) -> str:
    shown = {"review_date": "strftime(review_date, '%Y-%m-%d')"}
    shown.update({c: f"round({c}, 6)" for c in _DOUBLES})
    return ", ".join(f"{shown.get(c, c)} AS {c}" for c in columns)


def shown_standard(df, columns=_STANDARD):
    shown = {"review_date": day("review_date"), **{c: r6(c) for c in _DOUBLES}}
    return df.select(*[shown.get(c, F.col(c)).alias(c) for c in columns])


@query("final_projection", from_std(f"SELECT {_standard_sql()} FROM std"))
def final_projection(spark, sf):
    return shown_standard(std.final_projection(standard(spark, sf, extended=False)))


@query("standardize", from_std(f"SELECT ord, {_standard_sql()}, round(log_total_spent, 6) AS log_total_spent, "
                               "CAST(review_length AS BIGINT) AS review_length FROM std"))
def standardize(spark, sf):
    rows = standard(spark, sf)
    columns = {"review_date": day("review_date"), **{c: r6(c) for c in _DOUBLES}}
    return rows.select(
        "ord",
        *[columns.get(c, F.col(c)).alias(c) for c in _STANDARD],
        r6("log_total_spent").alias("log_total_spent"),
        F.col("review_length").cast("long").alias("review_length"),
    )


@query(
    "embed_projection",
    from_final(f"SELECT CAST(review_id AS VARCHAR) AS review_id, location, restaurant_name, "
               f"round(coalesce(rating_1_5, 0), 4) AS rating, {strip_sql('review_text')} AS text "
               f"FROM final WHERE length({strip_sql('review_text')}) > 0"),
)
def embed_projection(spark, sf):
    docs = index.embed_projection(final(spark, sf))
    return docs.withColumn("rating", F.round(F.col("rating").cast("double"), 4))


@query(
    "bad_row_skip",
    from_raw(f"""SELECT ord, CASE WHEN rating_raw = '1' THEN 0.0 ELSE TRY_CAST(rating_raw AS DOUBLE) END AS rating
      FROM raw WHERE length({strip_sql('review_text')}) > 0
      AND (rating_raw = '1' OR TRY_CAST(rating_raw AS DOUBLE) IS NOT NULL)"""),
)
def bad_row_skip(spark, sf):
    """Ratings as text cells; the cell '1' plays the blank one."""
    cells = raw(spark, sf).withColumn(
        "rating_1_5", F.when(F.col("rating_raw") == "1", F.lit("")).otherwise(F.col("rating_raw"))
    )
    docs = index.embed_projection(cells.withColumn("review_id", F.col("ord")))
    return docs.select(F.col("review_id").cast("long").alias("ord"), F.col("rating").cast("double").alias("rating"))


@query(
    "chunk_meta_projection",
    from_final("""SELECT CAST(review_id AS VARCHAR) AS review_id, location, restaurant_name,
      CAST(NULL AS VARCHAR) AS menu_item, CAST(NULL AS VARCHAR) AS sentiment,
      round(rating_1_5, 4) AS rating, strftime(review_date, '%Y-%m-%d') AS ts
      FROM final WHERE length(review_text) > 0"""),
)
def chunk_meta_projection(spark, sf):
    docs = index.chunk_projection(index.filter_nonempty_text(final(spark, sf)))
    return docs.select(
        "review_id", "location", "restaurant_name", "menu_item", "sentiment",
        F.round(F.col("rating").cast("double"), 4).alias("rating"), day("ts").alias("ts"),
    ).distinct()


@query(
    "filter_nonempty_text",
    from_raw(f"""SELECT ord, length({strip_sql('review_text')}) > 0 AS by_row FROM raw
      WHERE length(review_text) > 0"""),
)
def filter_nonempty_text(spark, sf):
    """Rows the chunk path keeps; ``by_row`` tells whether the row path keeps them too."""
    rows = raw(spark, sf).select("ord", "review_text")
    kept = index.filter_nonempty_text(rows)
    return kept.select("ord", (F.length(text.coerce_str(F.col("review_text"))) > 0).alias("by_row"))


@query("filter_term", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def filter_term(spark, sf):
    return filter_terms(table(spark, sf, "embeddings"), {"label": 3}).select("vec_id", "label")


@query(
    "filter_terms",
    "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source = 'src4'",
)
def filter_terms_query(spark, sf):
    wanted = {"lang": ["de", "fr"], "source": "src4"}
    return filter_terms(table(spark, sf, "documents"), wanted).select("doc_id", "lang", "source")


@query(
    "range_predicates",
    from_std("""SELECT source_file, count(*) FILTER (rating_1_5 < 1 OR rating_1_5 > 5) AS invalid_ratings,
      count(*) FILTER (tip_percentage > 30) AS extreme_tips,
      count(*) FILTER (review_length > 2000) AS long_reviews FROM std GROUP BY 1"""),
)
def range_predicates(spark, sf):
    return reports.range_checks(standard(spark, sf))


_REQUEST = """
  SELECT conv_id, turn, CASE (conv_id + turn) % 6
    WHEN 0 THEN '{"body": {"query": "' || q || '", "q": "x"}}'
    WHEN 1 THEN '{"body": "{\\"query\\": \\"\\", \\"q\\": \\"' || q || '\\"}", "q": "y"}'
    WHEN 2 THEN '{"query": "' || q || '"}'
    WHEN 3 THEN '{"body": "not json", "q": "' || q || '"}'
    WHEN 4 THEN '{"query": ""}'
    ELSE '{"body": {}, "other": "' || q || '"}' END AS request
  FROM (SELECT conv_id, turn, regexp_replace(text, '[^a-zA-Z ]+', ' '<ALL>) AS q
        FROM <CONVERSATIONS> WHERE role = 'user')
"""


@query(
    "request_query",
    """SELECT conv_id, turn, query, query IS NULL AS missing_query FROM (
      SELECT conv_id, turn, coalesce(
        nullif(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.query') END, ''),
        nullif(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.q') END, ''),
        nullif(json_extract_string(request, '$.query'), ''),
        nullif(json_extract_string(request, '$.q'), '')) AS query
      FROM (SELECT *, json_extract_string(request, '$.body') AS body FROM ("""
    + _REQUEST.replace("<ALL>", ", 'g'").replace("<CONVERSATIONS>", "conversations")
    + ")))",
)
def request_query(spark, sf):
    sql = _REQUEST.replace("{", "{{").replace("}", "}}").replace("\\", "\\\\")
    sql = sql.replace("<ALL>", "").replace("<CONVERSATIONS>", "{conversations}")
    requests = spark.sql(sql, conversations=table(spark, sf, "conversations"))
    return evaluate.parse_requests(requests).select("conv_id", "turn", "query", "missing_query")
