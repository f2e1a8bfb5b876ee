"""Sinks. Each writes a folder of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.fixed import STANDARD_COLUMNS

SNAPSHOT_COLUMNS = [n for n, _ in STANDARD_COLUMNS if n != "rating_scale"] + [
    "review_length",
    "mentions_wait",
]


def write_per_source(df: DataFrame, path: str) -> None:
    """Parquet in one folder per source file.

    The rebalance hint lets adaptive execution split a large source over many tasks and merge
    small ones; a plain repartition by source would put a hot source into one task. Dynamic
    overwrite replaces only the sources in this run.
    """
    (
        df.hint("rebalance", "source_file")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_file")
        .parquet(path)
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """Csv with a header per part. Cells with line breaks are quoted, quotes doubled."""
    flat = df.select(
        *[
            F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp_ntz" else F.col(c)
            for c, t in df.dtypes
        ]
    )
    flat.write.mode("overwrite").options(
        header=True, quoteAll=quote_all, escape='"', quote='"', emptyValue=""
    ).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def snapshot(df: DataFrame) -> DataFrame:
    """Columns of the exploration snapshot that the frame has."""
    return df.select(*[c for c in SNAPSHOT_COLUMNS if c in df.columns])


def write_snapshot(df: DataFrame, path: str) -> None:
    write_parquet(snapshot(df), path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines, one per row.

    No merge into one file: a report of distinct values may be long, and a merge would pull its
    last aggregation into one task. Adaptive execution joins small parts by itself.
    """
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
