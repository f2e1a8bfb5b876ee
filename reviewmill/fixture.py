"""Review relations derived from the driver tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# The text of a review, made of its document alone.
_TEXT = """CASE WHEN d.doc_id % 3 = 0 THEN (CASE WHEN d.doc_id % 2 = 0 THEN NULL ELSE '   ' END)
       WHEN d.doc_id % 7 = 0 THEN 'Good food, slow service.'
       ELSE d.text END"""
_BEFORE_TEXT = """
SELECT
  d.source || '.csv' AS source_file,
  d.doc_id AS ord,
  CAST(d.doc_id - (CASE WHEN d.doc_id % 10 = 9 THEN 9 ELSE 0 END) AS VARCHAR(20)) AS review_id,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE '  ' || c.c_name || ' ' END AS customer_name,
  CASE WHEN d.doc_id % 5 = 0
       THEN substr(CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR(20)), 6, 2) || '/' ||
            substr(CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR(20)), 9, 2) || '/' ||
            substr(CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR(20)), 1, 4)
       ELSE CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR(20)) END AS review_date,
  CASE CAST(substr(d.source, 4) AS INT) % 4
       WHEN 0 THEN CAST(1 + d.doc_id % 5 AS VARCHAR(20))
       WHEN 1 THEN CAST(1 + (d.doc_id * 7) % 10 AS VARCHAR(20))
       WHEN 2 THEN CAST(20 + (d.doc_id * 13) % 81 AS VARCHAR(20))
       ELSE 'four stars' END AS rating_raw,
"""
_AFTER_TEXT = """ AS review_text,
  d.lang AS location,
  d.source AS restaurant_name,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE CAST(o.o_totalprice AS DECIMAL(12,2)) END AS total_spent,
  CAST(l.tip AS DECIMAL(12,2)) AS tip_amount,
  CAST(CASE d.doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE d.doc_id % 45 END AS DECIMAL(12,2)) AS tip_percentage,
  l.n_lines AS party_size,
  CASE d.doc_id % 8 WHEN 0 THEN '18-25' WHEN 1 THEN '26-35' WHEN 2 THEN '36-45' WHEN 3 THEN '46-55'
       WHEN 4 THEN '56-65' WHEN 5 THEN '65+' WHEN 6 THEN 'unknown' END AS age_range,
  CASE d.doc_id % 7 WHEN 0 THEN 'M' WHEN 1 THEN ' Female ' WHEN 2 THEN 'non-binary'
       WHEN 3 THEN 'Prefer not to say' WHEN 4 THEN 'O' WHEN 5 THEN 'agender' END AS gender,
  CASE d.doc_id % 9 WHEN 0 THEN 'White' WHEN 1 THEN 'black' WHEN 2 THEN 'Latino' WHEN 3 THEN 'asian'
       WHEN 4 THEN 'mixed' WHEN 5 THEN 'Native American' WHEN 6 THEN 'Other' WHEN 7 THEN 'martian' END AS ethnicity
"""
_LINES = """LEFT JOIN (
  SELECT l_orderkey, max(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS tip,
         count(*) AS n_lines
  FROM {lineitem} GROUP BY l_orderkey
) l ON l.l_orderkey = o.o_orderkey
"""
# DuckDB runs this text; Spark runs ``reviews_raw``, which joins in another order.
REVIEWS_RAW = _BEFORE_TEXT + "  " + _TEXT + _AFTER_TEXT + """FROM {documents} d
JOIN {orders} o ON o.o_orderkey = d.doc_id
JOIN {customer} c ON c.c_custkey = o.o_custkey
""" + _LINES
_TEXTS_LAST = _BEFORE_TEXT + "  d.text" + _AFTER_TEXT + """FROM {documents} d
JOIN ({orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
""" + _LINES + """) ON o.o_orderkey = d.doc_id
"""

RESTAURANT_INFO = """
SELECT d.source AS restaurant_name, 'Main St ' || substr(d.source, 4) AS address,
       CAST(1 + 4 * avg(CAST(b.quality AS DOUBLE)) AS DECIMAL(4,2)) AS avg_stars,
       count(*) AS total_reviews
FROM {documents} d LEFT JOIN {labels} b ON b.doc_id = d.doc_id
WHERE d.source <> 'src3'
GROUP BY d.source
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def from_sql(spark: SparkSession, sf_dir: str, sql: str, **stead: DataFrame) -> DataFrame:
    """Run portable SQL whose table names stand in braces; ``stead`` replaces tables by name."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in sql and name not in stead}
    return spark.sql(sql, **used, **stead)


def plain(sql: str) -> str:
    """The same SQL with bare table names."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql.strip()


def reviews_raw(
    spark: SparkSession, sf_dir: str, text: Callable[[Column], Column] = lambda c: c
) -> DataFrame:
    """The rows of REVIEWS_RAW.

    Orders that belong to a document meet their customers and lines first, while rows are narrow.
    The texts come last and move once, as reviews show them, not as documents hold them.
    ``text`` is applied before they move, so a digest can go in place of a text.
    """
    documents, orders = table(spark, sf_dir, "documents"), table(spark, sf_dir, "orders")
    shown = documents.alias("d").select("doc_id", "lang", "source", text(F.expr(_TEXT)).alias("text"))
    known = orders.join(documents.select("doc_id"), F.col("o_orderkey") == F.col("doc_id"), "left_semi")
    return from_sql(spark, sf_dir, _TEXTS_LAST, documents=shown, orders=known)


def restaurant_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, RESTAURANT_INFO)
