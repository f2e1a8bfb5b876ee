"""Processed reviews to vector documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.numbers import coerce_numeric
from reviewmill.functions.text import coerce_str
from reviewmill.operators.chunks import explode_chunks
from reviewmill.operators.embed import Embedder, embed_batches


def filter_nonempty_text(df: DataFrame, text: str = "review_text", strip: bool = False) -> DataFrame:
    """Chunk path: length above 0. Row path (``strip``): not blank."""
    column = coerce_str(F.col(text)) if strip else F.col(text)
    return df.filter(F.length(column) > 0)


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def bad_row_skip(df: DataFrame, rating: str = "rating_1_5") -> DataFrame:
    """Drop rows whose rating is present but not a number; a blank rating stays."""
    if dict(df.dtypes)[rating] != "string":
        return df
    return df.filter(_blank(F.col(rating)) | coerce_numeric(F.col(rating)).isNotNull())


def embed_projection(
    df: DataFrame, text: str = "review_text", rating: str = "rating_1_5", keep: Sequence[str] = ()
) -> DataFrame:
    """Row-grain documents: id as text, blank rating as 0, trimmed text that is not blank.

    The default location stands in only where the column is absent.
    """
    kept = filter_nonempty_text(bad_row_skip(df, rating), text, strip=True)
    value = F.col(rating)
    if dict(df.dtypes)[rating] == "string":
        value = coerce_numeric(value)
    location = F.col("location") if "location" in df.columns else F.lit("NA")
    restaurant = "restaurant_name" if "restaurant_name" in df.columns else None
    return kept.select(
        F.coalesce(F.col("review_id").cast("string"), F.lit("")).alias("review_id"),
        F.coalesce(location, F.lit("")).alias("location"),
        (F.col(restaurant) if restaurant else F.lit(None).cast("string")).alias("restaurant_name"),
        F.coalesce(value, F.lit(0.0)).cast("float").alias("rating"),
        coerce_str(F.col(text)).alias("text"),
        *keep,
    )


def chunk_projection(df: DataFrame, text: str = "review_text", **chunking) -> DataFrame:
    """Chunk-grain documents: metadata of the review beside each chunk.

    Rating and time come from the standard columns; menu item and sentiment pass through if the
    input has them.
    """

    def own(name: str, standard: str | None, kind: str) -> Column:
        for candidate in (name, standard):
            if candidate in df.columns:
                return F.col(candidate).cast(kind).alias(name)
        return F.lit(None).cast(kind).alias(name)

    documents = df.select(
        F.col("review_id").cast("string").alias("review_id"),
        own("location", None, "string"),
        own("restaurant_name", None, "string"),
        own("menu_item", None, "string"),
        own("sentiment", None, "string"),
        own("rating", "rating_1_5", "float"),
        own("ts", "review_date", "timestamp_ntz"),
        F.col(text).alias("review_text"),
    )
    return explode_chunks(documents, "review_text", **chunking)


def embed_documents(docs: DataFrame, embedder: Embedder, text: str, batch: int = 64) -> DataFrame:
    """Documents with vectors; rows that could not be embedded keep a null vector."""
    return embed_batches(docs, embedder, text, batch)


