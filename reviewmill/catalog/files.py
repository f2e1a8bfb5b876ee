"""Scans and sinks. The files are written from the driver tables first, then read back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from reviewmill import fixture
from reviewmill.catalog.registry import (
    INFO, day, deduped, final, from_deduped, from_final, from_raw, from_std, query, r6, raw,
    standard,
)
from reviewmill.plans import profile, reports
from reviewmill.session import scratch_dir
from reviewmill.sources import files, sinks

# Headers of the staged files by source number modulo 4: every target under another spelling.
HEADERS = [
    {"review_id": "review_id", "customer_name": "customer_name", "review_date": "date",
     "rating_raw": "rating", "review_text": "review_text", "location": "location",
     "restaurant_name": "restaurant_name"},
    {"review_id": " Review Number ", "customer_name": "Guest Name", "review_date": "Visit Date",
     "rating_raw": "Satisfaction Score", "review_text": "Feedback Comments", "location": "Venue Location",
     "restaurant_name": "Business Name"},
    {"review_id": "ID", "customer_name": "name", "review_date": "review_date",
     "rating_raw": "rating_out_of_10", "review_text": "comments", "location": "venue",
     "restaurant_name": "establishment"},
    {"review_id": "review_number", "customer_name": "customer_name", "review_date": "Date",
     "rating_raw": "Star  Rating", "review_text": "Comments", "location": "location",
     "restaurant_name": "restaurant_name"},
]
SAME_NAMES = ["total_spent", "tip_amount", "tip_percentage", "party_size", "age_range", "gender", "ethnicity"]
SUFFIX = [".csv", ".csv", ".txt", ".csv"]
DELIMITER = [",", ",", ";", ","]
_GROUP = "CAST(substr(restaurant_name, 4) AS INT) % 4"


def stage_reviews(spark, sf) -> str:
    """Review files below one folder: a folder of parts per source, four header layouts."""
    root = scratch_dir(spark, "raw-reviews")
    rows = raw(spark, sf)
    for i, headers in enumerate(HEADERS):
        part = rows.filter(f"{_GROUP} = {i}").withColumn(
            "source", F.regexp_replace("source_file", "\\.csv$", SUFFIX[i])
        )
        named = part.select(
            "source", *[F.col(c).cast("string").alias(h) for c, h in headers.items()],
            *[F.col(c).cast("string").alias(c) for c in SAME_NAMES],
        )
        named.hint("rebalance", "source").write.mode("append").partitionBy("source").options(
            header=True, sep=DELIMITER[i], quote='"', escape='"', emptyValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        ).csv(root)
    return root


def resolved_sources(spark, sf):
    found = files.list_sources(spark, stage_reviews(spark, sf), by="folder")
    return files.resolve_sources(spark, found)


def scanned(spark, sf, multi_line="auto"):
    return files.scan_reviews(spark, resolved_sources(spark, sf), multi_line)


def stage_one(spark, df, name: str, **options) -> str:
    """One delimited source folder, e.g. ``.../reviews.csv``."""
    path = os.path.join(scratch_dir(spark, "one"), name)
    write_one(df, path, **options)
    return path


def write_one(df, path: str, mode: str = "error", **options) -> None:
    df.write.mode(mode).options(
        **{"header": True, "quote": '"', "escape": '"', "emptyValue": "",
           "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, **options}
    ).csv(path)


_CELLS = ["review_id", "review_text", "gender", "location"]
_CELLS_SQL = "SELECT review_id, review_text, gender, location FROM raw"


def _cells(spark, sf):
    return raw(spark, sf).select(*_CELLS)


@query("scan_csv", from_raw(_CELLS_SQL))
def scan_csv(spark, sf):
    return files.scan_csv(spark, stage_one(spark, _cells(spark, sf), "reviews.csv"))


@query("scan_csv_stitched", from_raw(_CELLS_SQL))
def scan_csv_stitched(spark, sf):
    """Quoted line breaks without reading a whole file in one task."""
    path = stage_one(spark, _cells(spark, sf), "reviews.csv")
    return files.scan_csv(spark, path, multi_line="stitch")


@query("scan_txt_sniff", from_raw(_CELLS_SQL))
def scan_txt_sniff(spark, sf):
    return files.scan_csv(spark, stage_one(spark, _cells(spark, sf), "reviews.txt", sep="|"))


@query("scan_fallback", from_raw("SELECT review_id, review_text FROM raw"))
def scan_fallback(spark, sf):
    """A header on which the candidates tie is read with commas."""
    renamed = _cells(spark, sf).select("review_id", F.col("review_text").alias("text;of review"))
    path = stage_one(spark, renamed, "reviews.txt", quoteAll=False)
    return files.scan_csv(spark, path).withColumnRenamed("text;of review", "review_text")


@query("scan_delim_by_header", from_raw("SELECT review_id, coalesce(review_text, '') AS review_text FROM raw"))
def scan_delim_by_header(spark, sf):
    path = stage_one(spark, _cells(spark, sf).select("review_id", "review_text"), "reviews.csv", sep="\t")
    return files.scan_by_header(spark, path)


@query(
    "scan_lossy_utf8",
    "SELECT CAST(doc_id AS VARCHAR) AS review_id, 'caf' || chr(65533) || ' ' || lang AS review_text FROM documents",
)
def scan_lossy_utf8(spark, sf):
    """Bytes that are not UTF-8 become replacement characters."""
    documents = fixture.table(spark, sf, "documents")
    latin = documents.select(
        F.col("doc_id").cast("string").alias("review_id"), F.concat(F.lit("café "), "lang").alias("review_text")
    )
    return files.scan_by_header(spark, stage_one(spark, latin, "reviews.csv", encoding="ISO-8859-1"))


@query("discover_files", from_raw(
    "SELECT DISTINCT replace(source_file, '.csv', CASE WHEN " + _GROUP + " = 2 THEN '.txt' ELSE '.csv' END) "
    "AS source FROM raw"))
def discover_files(spark, sf):
    found = files.discover_files(spark, stage_reviews(spark, sf))
    return found.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).distinct()


@query(
    "skip_unreadable",
    from_raw("SELECT DISTINCT replace(source_file, '.csv', CASE WHEN " + _GROUP + " = 2 THEN '.txt' ELSE '.csv' END) "
             "AS source_file, 'ok' AS status FROM raw UNION ALL SELECT 'empty.csv', 'unreadable'"),
)
def skip_unreadable(spark, sf):
    root = stage_reviews(spark, sf)
    blank = fixture.table(spark, sf, "region").select(F.lit("").alias("value")).limit(1)
    blank.write.text(os.path.join(root, "source=empty.csv"))
    listed = files.list_sources(spark, root, by="folder")
    return files.file_report(spark, files.resolve_sources(spark, listed)).select("source_file", "status")


@query(
    "refused_files",
    from_raw("SELECT DISTINCT replace(source_file, '.csv', CASE WHEN " + _GROUP + " = 2 THEN '.txt' ELSE '.csv' END) "
             "AS source, 'taken' AS status, false AS has_reason FROM raw UNION ALL SELECT r_name || '.json', 'refused', true FROM region"),
)
def refused_files(spark, sf):
    """Files of another type lie beside the reviews; each has its status."""
    root = stage_reviews(spark, sf)
    other = fixture.table(spark, sf, "region").withColumn("source", F.concat("r_name", F.lit(".json")))
    other.write.mode("append").partitionBy("source").json(root)
    found = files.file_statuses(spark, root)
    source = F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")
    return found.select(F.url_decode(source).alias("source"), "status", F.col("error").isNotNull().alias("has_reason")).distinct()


_SCANNED = from_raw(
    """SELECT replace(source_file, '.csv', CASE WHEN """ + _GROUP + """ = 2 THEN '.txt' ELSE '.csv' END) AS source_file,
      review_id, customer_name, review_date, rating_raw, review_text, location, restaurant_name,
      CAST(total_spent AS VARCHAR) AS total_spent, age_range, gender, true AS has_rating FROM raw"""
)


def _scan_columns(df):
    return df.select(
        "source_file", "review_id", "customer_name", "review_date", "rating_raw", "review_text",
        "location", "restaurant_name", "total_spent", "age_range", "gender", "has_rating",
    )


@query("map_columns", _SCANNED)
def map_columns(spark, sf):
    """Four header layouts read as one relation."""
    return _scan_columns(scanned(spark, sf))


@query("map_columns_stitched", _SCANNED)
def map_columns_stitched(spark, sf):
    return _scan_columns(scanned(spark, sf, multi_line="stitch"))


_NORMALIZED = [
    {t: "_".join(h.strip().lower().split()) for t, h in {**g, **{c: c for c in SAME_NAMES}}.items()}
    for g in HEADERS
]


@query(
    "schema_audit",
    from_raw("SELECT DISTINCT replace(source_file, '.csv', CASE WHEN " + _GROUP
             + " = 2 THEN '.txt' ELSE '.csv' END) AS source_file, unified_col, raw_col FROM raw JOIN (VALUES "
             + ", ".join(f"({i}, '{t}', '{h}')" for i, g in enumerate(_NORMALIZED) for t, h in g.items())
             + f") AS m(grp, unified_col, raw_col) ON m.grp = {_GROUP}"),
)
def schema_audit(spark, sf):
    return files.schema_audit(spark, resolved_sources(spark, sf))


@query(
    "normalize_header",
    from_raw("SELECT DISTINCT replace(source_file, '.csv', CASE WHEN " + _GROUP
             + " = 2 THEN '.txt' ELSE '.csv' END) AS source_file, header FROM raw JOIN (VALUES "
             + ", ".join(f"({i}, '{h}')" for i, g in enumerate(_NORMALIZED) for h in g.values())
             + f") AS m(grp, header) ON m.grp = {_GROUP}"),
)
def normalize_header(spark, sf):
    rows = [(s.name, h) for s in resolved_sources(spark, sf) for h in s.headers]
    return spark.createDataFrame(rows, "source_file string, header string")


_NAMED = [i for i, g in enumerate(_NORMALIZED) if g["review_id"] == "review_id"]
_CALLED = [i for i, g in enumerate(_NORMALIZED) if g["customer_name"] == "customer_name"]


@query(
    "raw_integrity",
    from_raw(f"""SELECT replace(source_file, '.csv', CASE WHEN {_GROUP} = 2 THEN '.txt' ELSE '.csv' END) AS source_file,
      count(*) AS total_rows,
      CASE WHEN {_GROUP} IN ({", ".join(map(str, _NAMED))}) THEN count(DISTINCT review_id) END AS unique_reviews,
      CASE WHEN {_GROUP} IN ({", ".join(map(str, _CALLED)) or -1}) THEN count(DISTINCT customer_name) END AS unique_customers
      FROM raw GROUP BY source_file, {_GROUP}"""),
)
def raw_integrity(spark, sf):
    """All raw files under their own headers: distinct values only where the header has the name."""
    frames = files.scan_raw(spark, resolved_sources(spark, sf))
    totals = profile.union_all([reports.integrity_totals(f) for f in frames])
    return totals.select("source_file", "total_rows", "unique_reviews", "unique_customers")


@query(
    "scan_metadata",
    f"WITH {INFO} SELECT restaurant_name, address, CAST(avg_stars AS DOUBLE) AS avg_stars, "
    "CAST(total_reviews AS DOUBLE) AS total_reviews FROM info",
)
def scan_metadata(spark, sf):
    info = fixture.restaurant_info(spark, sf).select(
        F.col("restaurant_name").alias(" Restaurant Name "), F.col("address").alias("Address"),
        F.col("avg_stars").alias("Avg Stars"), F.col("total_reviews").alias("TOTAL_REVIEWS "),
    )
    return files.scan_metadata(spark, stage_one(spark, info, "info.csv"))


_PLAIN = "SELECT review_id, ord, source_file, gender_norm FROM {}"


@query("scan_parquet", from_final(_PLAIN.format("final")))
def scan_parquet(spark, sf):
    path = scratch_dir(spark, "processed")
    sinks.write_parquet(final(spark, sf), path)
    return files.scan_processed(spark, path).select("review_id", "ord", "source_file", "gender_norm")


@query(
    "scan_records",
    """SELECT CAST(doc_id AS VARCHAR) AS review_id, lang AS location, CAST(n_chars % 5 AS FLOAT) AS rating, text
      FROM documents UNION ALL SELECT doc_id || '-b', NULL, CAST(0.5 AS FLOAT), source FROM documents""",
)
def scan_records(spark, sf):
    """One request per document, with two records each."""
    first = F.struct(
        F.col("doc_id").cast("string").alias("review_id"), F.col("lang").alias("location"),
        (F.col("n_chars") % 5).cast("float").alias("rating"), F.col("text").alias("text"),
    )
    second = F.struct(
        F.concat(F.col("doc_id").cast("string"), F.lit("-b")).alias("review_id"),
        F.lit(None).cast("string").alias("location"), F.lit(0.5).cast("float").alias("rating"),
        F.col("source").alias("text"),
    )
    request = F.to_json(F.struct(F.array(first, second).alias("records")))
    return files.scan_records(fixture.table(spark, sf, "documents").select(request.alias("request")))


# --- sinks -------------------------------------------------------------------


@query("sink_per_source", from_deduped("SELECT source_file, ord, review_id, gender_norm FROM deduped"))
def sink_per_source(spark, sf):
    path = scratch_dir(spark, "per-source")
    sinks.write_per_source(deduped(spark, sf), path)
    return spark.read.parquet(path).select("source_file", "ord", "review_id", "gender_norm")


@query("sink_final_parquet", from_final("SELECT review_id, ord, round(rating_1_5, 6) AS rating_1_5 FROM final"))
def sink_final_parquet(spark, sf):
    path = scratch_dir(spark, "final")
    sinks.write_parquet(final(spark, sf), path)
    return spark.read.parquet(path).select("review_id", "ord", r6("rating_1_5").alias("rating_1_5"))


_CSV_SQL = from_final("SELECT CAST(review_id AS VARCHAR) AS review_id, review_text, source_file, "
                      "strftime(review_date, '%Y-%m-%d') AS review_date FROM final")


def _csv_round_trip(spark, sf, quote_all):
    path = os.path.join(scratch_dir(spark, "final"), "final.csv")
    rows = final(spark, sf).select("review_id", "review_text", "source_file", "review_date")
    sinks.write_csv(rows, path, quote_all)
    return files.scan_csv(spark, path).withColumn("review_date", F.substring("review_date", 1, 10))


@query("sink_final_csv", _CSV_SQL)
def sink_final_csv(spark, sf):
    return _csv_round_trip(spark, sf, False)


@query("sink_final_csv_quoted", _CSV_SQL)
def sink_final_csv_quoted(spark, sf):
    return _csv_round_trip(spark, sf, True)


@query("sink_jsonl", from_final("SELECT review_id, review_text, gender_norm FROM final"))
def sink_jsonl(spark, sf):
    path = scratch_dir(spark, "jsonl")
    sinks.write_json_lines(final(spark, sf).select("review_id", "review_text", "gender_norm"), path)
    return spark.read.schema("review_id long, review_text string, gender_norm string").json(path)


@query(
    "sink_snapshot",
    from_final("""SELECT review_id, source_file, strftime(review_date, '%Y-%m-%d') AS review_date,
      round(rating_1_5, 6) AS rating_1_5, CAST(review_length AS BIGINT) AS review_length,
      coalesce(contains(lower(review_text), 'wait') OR contains(lower(review_text), 'queue')
        OR contains(lower(review_text), 'line') OR contains(lower(review_text), 'delay'), false) AS mentions_wait
      FROM final"""),
)
def sink_snapshot(spark, sf):
    path = scratch_dir(spark, "snapshot")
    sinks.write_snapshot(profile.with_wait_flag(final(spark, sf)), path)
    stored = spark.read.parquet(path)
    if "rating_scale" in stored.columns:
        raise ValueError("the snapshot has no rating scale")
    return stored.select(
        "review_id", "source_file", day("review_date").alias("review_date"),
        r6("rating_1_5").alias("rating_1_5"), F.col("review_length").cast("long").alias("review_length"),
        "mentions_wait",
    )


@query(
    "sink_report_json",
    from_std("SELECT source_file, count(*) AS total_rows, count(DISTINCT review_id) AS unique_reviews FROM std GROUP BY 1"),
)
def sink_report_json(spark, sf):
    path = scratch_dir(spark, "report")
    sinks.write_report(reports.integrity_totals(standard(spark, sf)), path)
    lines = spark.read.schema("source_file string, total_rows long, unique_reviews long").json(path)
    return lines
